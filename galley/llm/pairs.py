"""Problem 6: defective pairs of prompt and response, each with its defect.

The language of the response is judged by the posteriors of prompt and response under
a naive Bayes model on character n-grams, trained here on a bounded sample of labelled
documents: a response is expected in English or, left undone, in the prompt's
language, so that the prompt's posterior is the prior of what is not English. Whether
an answer breaks off is judged by the likelihood of the shape of its end in its
script, trained on the ends of all prompts; the other defects by what the answer says.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.llm.looks import _INVISIBLE, default_form
from galley.llm.repeats import SHARE, repeated_share
from galley.llm.sentences import MEDIAL, Splitter, _key
from galley.session import checkpointed, table

#: Bounds of the language model: labelled documents it is trained on at most, and n-grams kept of a language.
SAMPLE, GRAMS = 3000, 20_000
#: Prior of a language that neither is English nor the prompt's.
FLOOR = 0.05
#: An end is likely if its shape is at least this often the end of a prompt, against the most frequent shape of the script.
END_RATIO = 0.02
#: A refusal's sentences speak of declining or of the work in this share at least; or it keeps less than LEFT of an English prompt's words.
DECLINING, LEFT = 0.25, 0.2
#: A prompt of this many letters and digits is not found whole at the end of an answer by chance.
LONG = 40

# What stands in front of an answer, words for nothing, and how work is declined.
_LABEL = regex.compile(
    r"^\s*(?:(?:\[\d{1,3}\]|\(\d{1,3}\)|\#{1,4}(?=\s)|>(?=\s)|```\w*|\*\*(?:\w+ ){0,3}\w+:?\*\*:?|"
    r"(?:REPLACE|KEEP|OUTPUT|ANSWER|RESULT|REWRITE|REWRITTEN|EDITED|TRANSLATION|TEXT|NOTE)\b\s*:|"
    r"(?i:(?:sure|certainly|of course|okay|ok|absolutely|no problem)\b[!,.]?\s*(?:here (?:you go|it is|is [^\n:]{0,50})\s*[:.!]?)?(?=\s|$)|"
    r"here(?:'s|’s| is| are)\b[^\n:.]{0,60}:|below is\b[^\n:.]{0,60}:|"
    r"(?:the )?(?:rewritten|edited|revised|polished|corrected|translated|improved|final|updated)\s+(?:\w+\s?){1,3}:|"
    r"(?:note|answer|output|result|response|translation|rewrite|edit|text|replace|assistant)\s*:))\s*)+"
)
_TRAIL = regex.compile(r"(?:\s*```)+\s*$")
_NOTHING = set("null none nil na nothing empty nooutput nan blank noanswer nochange nochanges notext nocontent nothingtochange noresponse undefined tbd void".split())
_REFUSAL = regex.compile(
    r"(?i)\b(?:i(?:'|’)?m sorry|i am sorry|sorry|i apologi[sz]e|my apologies|apologies|unfortunately|regrettably|i(?: can| could|'m|’m| am| must| have to| will|'d|’d)?\s*(?:cannot|can ?not|can(?:'|’)?t|could not|couldn(?:'|’)?t|won(?:'|’)?t|unable|not able|decline|refuse|not comfortable|not allowed|not permitted)"
    r"|unable to (?:comply|assist|help|process|provide|complete|fulfil|rewrite|edit)|must decline|have to (?:refuse|decline)|(?:my|the|our|content|safety) (?:guidelines|policy|policies|filter)|policy reasons|against (?:my|the) (?:guidelines|policy)"
    r"|as an? (?:ai|language (?:model|assistant)|assistant)|can(?:'|’)?t (?:help|assist|rework|rewrite|edit|process|do)|cannot (?:be processed|help|assist|rewrite|edit|process|comply|continue|fulfil)|request (?:declined|denied|rejected|blocked|refused)|did not (?:edit|rewrite|process)|no (?:rewrite|edit|edits|translation|answer|output|revision|version) (?:was |is |can be |will be )?(?:provided|given|possible|available|produced|made)"
    r"|(?:falls?|lies|is) outside (?:what|of what|my|our|the)|is(?:n(?:'|’)t| not) (?:possible|something i)|do(?:es)? not (?:let|allow|permit) me|not (?:able|willing) to (?:edit|rewrite|help|assist|continue|process))\b"
)
#: Every refusal has one of these; most answers have none and are spared the expression.
_CUES = ("sorr", "apolog", "unfortunat", "regrettab", "cannot", "can not", "can't", "can’t", "could", "won't", "won’t", "unable", "not ", "declin", "refus", "guideline", "polic", "filter", "as a", "outside", "isn't", "isn’t", "no ", "denied", "rejected", "blocked")
_WORK = regex.compile(
    r"(?i)\b(?:requests?|rewrit\w*|rework\w*|edit\w*|assist\w*|help\w*|process\w*|comply|content|passage|span|text|paragraph|guidelines|polic\w+|filter|scene|material|translat\w*|provide|continue|this one|do this|do that|with that|with this|polish\w*|refuse|decline)\b"
)
_QUOTED_SPEECH = regex.compile(r"[\"“«„「][^\"”»“」]{0,400}(?:[\"”»“」]|$)")
_SIGN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_LETTERS = regex.compile(r"\p{L}")
_LATIN = regex.compile(r"\p{Latin}")
_END = regex.compile(r"[.!?…。！？।؟]+[\"”»“’')\]」』*\s]*$")
# Scripts whose ends are counted apart; a text is of the first that has half of its letters.
_SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "east": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}", "arabic": r"\p{IsArabic}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}", "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}"}
_OF_SCRIPT = {name: regex.compile(signs) for name, signs in _SCRIPTS.items()}
_PAUSED = regex.compile(r"[,;:،，、—–-][\"”»’')\]」』\s]*$")


def bare(text: str | None) -> str:
    """The answer without labels, fences, invisible signs and outer white space."""
    if not text:
        return ""
    text = _INVISIBLE.sub("", text) if not text.isascii() else text
    return _TRAIL.sub("", _LABEL.sub("", text)).strip()


def wording(text: str) -> str:
    """What remains of ``text`` without case, spacing, punctuation and look-alikes."""
    return "".join(_SIGN.findall(default_form()(text).casefold()))


def shape(text: str) -> str:
    """The last signs of a text as classes: letters, digits, and each mark itself."""
    end = text.rstrip()[-3:]
    return "".join("a" if c.isalpha() or regex.match(r"\p{M}", c) else "0" if c.isdigit() else " " if c.isspace() else c for c in end)


def script(text: str) -> str:
    """The script of a text; those told apart by nothing here are one, and a text without letters counts as Latin."""
    if text.isascii():
        return "latin"
    letters = len(_LETTERS.findall(text))
    return next((name for name, signs in _OF_SCRIPT.items() if 2 * len(signs.findall(text)) >= letters), "other")


@dataclass
class Languages:
    """Naive Bayes on character 3-grams of words and the blanks between them."""

    names: list[str] = field(default_factory=list)
    row_of: dict[str, int] = field(default_factory=dict)  # an n-gram's row of ``logs``; the last row is for unseen ones
    logs: np.ndarray | None = None

    @staticmethod
    def grams(text: str) -> list[str]:
        line = f" {' '.join(w for w in _SIGN.findall(text.lower()) if not w.isdigit())} "
        if len(line) < 3:
            return []
        return list(map("".join, zip(line, line[1:], line[2:])))

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> Languages:
        """From (language, text); only the GRAMS most frequent n-grams of a language are kept."""
        total: dict[str, Counter] = defaultdict(Counter)
        for lang, text in rows:
            total[lang].update(cls.grams(text))
        kept = {lang: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:GRAMS]) for lang, c in total.items()}
        return cls.of_counts(kept, {lang: sum(c.values()) for lang, c in total.items()})

    @classmethod
    def of_counts(cls, kept: dict[str, dict[str, int]], total: dict[str, int]) -> Languages:
        """From the counts of each language's kept n-grams and of all of its n-grams."""
        model = cls(sorted(total))
        for c in kept.values():
            for g in c:
                model.row_of.setdefault(g, len(model.row_of))
        model.logs = np.full((len(model.row_of) + 1, len(model.names)), 0.5)
        for k, lang in enumerate(model.names):
            for g, n in kept.get(lang, {}).items():
                model.logs[model.row_of[g], k] += n
            model.logs[:, k] = np.log(model.logs[:, k] / (total[lang] + GRAMS))
        return model

    def posterior(self, text: str) -> dict[str, float]:
        """Probability of each language; empty where the text has no letters or nothing was trained."""
        grams = self.grams(text)
        if not grams or self.logs is None or not self.names:
            return {}
        unseen = len(self.row_of)
        rows = np.fromiter(map(self.row_of.get, grams, repeat(unseen)), np.int64, len(grams))
        score = self.logs[rows].sum(axis=0)
        odds = np.exp(np.maximum(score - score.max(), -700.0))
        return dict(zip(self.names, (odds / odds.sum()).tolist()))


class Judge:
    """Tells the defect of a pair; built once in each task.

    ``ends`` has how often each (script, shape) ends a prompt; a shape alone is of Latin texts.
    """

    def __init__(self, languages: Languages, ends: dict[tuple[str, str] | str, int]) -> None:
        self.languages = languages
        self.ends = {k if isinstance(k, tuple) else ("latin", k): n for k, n in ends.items()}
        self.most: dict[str, int] = defaultdict(int)
        for (of, _), n in self.ends.items():
            self.most[of] = max(self.most[of], n)
        self.split = Splitter().starts
        self.medial = {_key(x) for x in MEDIAL}

    def defect(self, before: str | None, after: str | None) -> str | None:
        """The defect of ``after`` as an answer to ``before``; None if it serves.

        A null or empty answer is `empty` whatever the prompt; a null or empty prompt
        is no fragment and nothing can be its copy. Very long texts are read whole.
        """
        answer, prompt = bare(after), (before or "").strip()
        form = answer if answer.isascii() else default_form()(answer)
        said = "".join(_SIGN.findall(form.casefold()))
        if not said or said in _NOTHING:
            return "empty"
        asked = wording(prompt)
        if self._refuses(form, prompt, asked):
            return "refusal"
        if said == asked or asked and said.endswith(asked) and self._announced(form, prompt, asked):
            return "copy"
        foreign = self._foreign(answer, prompt)
        if not foreign and not self._truncated(prompt, answer):
            return None
        # an answer caught in a loop is judged by its language alone, each word of it once
        looping = repeated_share(answer) >= SHARE
        if foreign and looping:
            foreign = self._foreign(" ".join(dict.fromkeys(answer.split())), prompt)
        if foreign or not looping:
            return "language" if foreign else "truncated"
        return None

    @staticmethod
    def _announced(form: str, prompt: str, asked: str) -> bool:
        """Whether what precedes a copy is no rewrite of it; before a short prompt it must also end like an announcement."""
        left, at = len(asked), len(form)
        while left > 0 and at:  # back over the copy's letters and digits
            at -= 1
            left -= len(wording(form[at]))
        head = form[:at]
        if len(asked) < LONG and not regex.search(r"[:\n\])][^\p{L}\p{N}]*$", head):
            return False
        words = {w for w in _SIGN.findall(head.lower()) if len(w) > 3}
        wanted = {w for w in _SIGN.findall(default_form()(prompt).lower()) if len(w) > 3}
        # a rewrite says little else than the prompt, and a good part of it
        return 2 * sum(w in asked for w in words) < len(words) or 4 * len(wanted & words) < len(wanted) or not words

    def _refuses(self, form: str, prompt: str, asked: str) -> bool:
        """Whether the answer, look-alikes removed, declines: judged over all of its sentences."""
        low = form.lower()
        if not any(c in low for c in _CUES):
            return False
        plain = _QUOTED_SPEECH.sub(" ", form)
        if not _REFUSAL.search(plain) or not _WORK.search(plain):
            return False
        # an answer that rewrites keeps most of an English prompt's words
        first = {w for w in _SIGN.findall(low) if len(w) > 3}
        if sum(w in asked for w in first) >= 0.5 * len(first):
            return False
        starts = self.split(plain)
        sentences = [plain[a:b] for a, b in zip(starts, [*starts[1:], len(plain)])]
        declines = [bool(_REFUSAL.search(x)) for x in sentences]
        works = [bool(_WORK.search(x)) for x in sentences]
        if sum(a or b for a, b in zip(declines, works)) >= DECLINING * len(sentences):
            return True
        # a long explanation: the work is declined in so many words and the prompt's are gone
        wanted = {w for w in _SIGN.findall(default_form()(prompt).lower()) if len(w) > 3}
        there = sum(w in low for w in wanted)
        return any(a and b for a, b in zip(declines, works)) and bool(wanted) and there < LEFT * len(wanted) and not self._foreign(prompt)

    def _foreign(self, answer: str, prompt: str | None = None) -> bool:
        """Whether ``answer`` is not English, given that it is so or in the language of ``prompt``."""
        if not answer.isascii():
            letters = len(_LETTERS.findall(answer))
            if 2 * len(_LATIN.findall(answer)) < letters:
                return True
        p = self.languages.posterior(answer)
        english = p.get("en", 0.0)
        # the prior favours English by 1 to (1 + FLOOR) / FLOOR: other odds are decided without the prompt
        if not p or english >= 0.5:
            return False
        if prompt is None or english * (1 + FLOOR) < FLOOR * (1 - english):
            return True
        asked = self.languages.posterior(prompt)
        prior = {x: 0.5 * (x == "en") + 0.5 * asked.get(x, 0.0) + FLOOR for x in p}
        return english * prior["en"] < 0.5 * sum(p[x] * prior[x] for x in p)

    def _truncated(self, prompt: str, answer: str) -> bool:
        if not prompt or not self._complete(prompt):
            return False
        if not self._complete(answer):
            return True
        if self._open_quotes(answer) and not self._open_quotes(prompt):
            return True
        return len(self.split(answer)) == 1 and len(self.split(prompt)) >= 4

    def _complete(self, text: str) -> bool:
        """Whether the end of ``text`` is likely to be one."""
        tail = text[-64:]  # the marks at the end and the word before them
        if _PAUSED.search(tail):
            return False
        if not _END.search(tail):
            thai = len(regex.findall(r"[ก-๛]", text))
            if 2 * thai > len(_LETTERS.findall(text)):
                return True
            of = script(text)
            most = self.most.get(of, 0)
            return most > 0 and self.ends.get((of, shape(text)), 0) >= END_RATIO * most
        word = regex.search(r"([\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*)\.$", tail)
        return not (word and _key(word[1]) in self.medial and len(word[1]) < 6 and _key(word[1]) not in ("no", "art", "est", "sec", "ex", "fig", "col", "gen", "d", "m", "s", "p"))

    @staticmethod
    def _open_quotes(text: str) -> bool:
        return text.count('"') % 2 == 1 or text.count("“") + text.count("„") > text.count("”") + (text.count("“") if "„" in text else 0) or text.count("«") > text.count("»") or text.count("「") > text.count("」") or text.count("(") > text.count(")")


def train_languages(docs: DataFrame, sample: int = SAMPLE) -> Languages:
    """The language model of a hashed sample of at most about ``sample`` labelled documents (doc_id, lang, text).

    N-grams are counted where the texts are; only those kept reach the driver.
    """
    lang = F.lower(F.trim("lang"))
    labelled = docs.filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    n = labelled.count()
    # the share that gives the bound; every language is trained on what falls into it
    some = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // sample)))) == 0)
    arrow = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def make():
        def run(c):
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(c["lang"], c["text"]):
                counts[lang].update(Languages.grams(text))
            rows = [(lang, g, k) for lang, of in counts.items() for g, k in of.items()]
            return {name: [r[i] for r in rows] for i, name in enumerate(arrow.names)}

        return run

    counted = map_columns(some.select(lang.alias("lang"), "text"), make, "lang string, gram string, n bigint", arrow)
    counted = checkpointed(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    kept: dict[str, dict[str, int]] = {}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    for r in counted.withColumn("place", place).filter(F.col("place") <= GRAMS).collect():
        kept.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return Languages.of_counts(kept, total)


def end_shapes(pairs: DataFrame) -> dict[tuple[str, str], int]:
    """How often each shape ends a prompt of each script, over all pairs: all shapes that are likely there."""
    end = F.substring(F.regexp_replace("before", r"\s+$", ""), -3, 3)
    for pattern, sign in ((r"[\p{L}\p{M}]", "a"), (r"\p{Nd}", "0"), (r"\s", " ")):
        end = F.regexp_replace(end, pattern, sign)
    letters = F.regexp_count("before", F.lit(r"\p{L}"))
    of = F.when(F.octet_length("before") == F.char_length("before"), "latin")
    for name, signs in _SCRIPTS.items():
        of = of.when(2 * F.regexp_count("before", F.lit(signs)) >= letters, name)
    counts = pairs.filter("before IS NOT NULL").groupBy(of.otherwise("other").alias("script"), end.alias("shape")).count()
    most = F.max("count").over(Window.partitionBy("script"))
    return {(r["script"], r["shape"]): r["count"] for r in counts.withColumn("most", most).filter(F.col("count") >= END_RATIO * F.col("most")).collect()}


def with_defects(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(edit_id, defect) of ``pairs`` (edit_id, before, after); null where an answer serves.

    ``docs`` (doc_id, lang, text) trains the language model. An empty table gives no
    rows; repeated rows are judged alike.
    """
    languages, ends = train_languages(docs), end_shapes(pairs)
    shared = pairs.sparkSession.sparkContext.broadcast((languages, ends))  # GRAMS n-grams a language, and shapes
    arrow = pa.schema([("edit_id", pa.int64()), ("defect", pa.string())])

    def make():
        judge = Judge(*shared.value).defect
        return lambda c: {"edit_id": c["edit_id"], "defect": [judge(b, a) for b, a in zip(c["before"], c["after"])]}

    return map_columns(pairs.select("edit_id", "before", "after"), make, "edit_id bigint, defect string", arrow)


def p6_found(spark, sf_dir: str) -> DataFrame:
    return with_defects(table(spark, sf_dir, "edits"), table(spark, sf_dir, "documents")).filter("defect IS NOT NULL").select("edit_id", "defect")


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
