"""Problem 3: sentences in every language and script, in order and with nothing lost.

A mark is judged by what stands around it. Whether a word before a period is an
abbreviation, and whether one after it is a name, is decided by the document first (it
occurs there before a small letter, or without a period as a word or a name), then by
the corpus (it nearly always does), then by a list; marks of scripts without case or
without periods have rules of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import repeat
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.llm.looks import _INVISIBLE, default_form
from galley.session import checkpointed, table

# Abbreviations of eight languages, without their last period.
MEDIAL = """
mr mrs ms dr prof st lt col capt sgt gen rev hon mt ft messrs mme mlle vs cf viz e.g i.e approx no nos vol vols ch chs p pp
fig figs sec ed eds est dept art ca resp incl
sr sra srta dra d dña cap caps pág págs núm p.ej ej
m mm chap av éd p.ex ex
hr fr nr kap bd abs s z.b d.h u.a o.ä bzw vgl evtl ggf sog
г гл ул д т.е см стр рис напр проф им
डॉ श्री प्रो
""".split()  # fmt: skip
# Words of the list that are also ordinary words; in small letters they abbreviate before numbers alone.
NUMBERED = set("no nos art cap caps chap ch chs col ex est sec fig figs gen hon rev ed ft vol vols".split())
FINAL = "etc a.m p.m u.k u.s u.s.a usw u.s.w т.д т.п др inc ltd co jr bros".split()
_ORDINAL_BEFORE = set("am der dem den des die das im vom zum beim seit bis ab jeder jedem jeden".split())

# Words that say who speaks.
_SAYS = r"(?:said|says|asked|demanded|shouted|called|cried|murmured|told|whispered|replied|answered|exclaimed|added|muttered|yelled|remarked|insisted|declared|snapped|sighed|screamed|continued|repeated|warned|begged|laughed|groaned|hissed|growled|suggested|agreed|announced|admitted|protested|observed|noted|inquired)"
_ATTRIBUTION = regex.compile(rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}’'.-]*\s+){{1,3}}{_SAYS}\b(?!\s+(?:for|about|whether|if|it|that)\b)")
_CASELESS_SAYS = regex.compile("[道说問问喊叫答吼嚷喝]|^と|물었|말했|외쳤|대답했|소리|속삭|중얼|पूछा|कहा|बोल|चिल्ला|سأل|قال|صاح|هتف|أجاب|همس|ถาม|กล่าว|ตะโกน")

_MARKS = re.compile(r"[.!?…؟।॥。！？｡．‼⁇⁈⁉]+|\n[^\S\n]*\n")
_EAST_MARKS = frozenset("。！？｡।॥")
_CLOSE = frozenset("”»›)]）】」』〉》")
_NARROW = frozenset(" \u00a0\u2009\u202f")
_OPEN = regex.compile(r"[\"'“”„«»‹›‘’(\[（【「『〈《¡¿—–\-\s*_#>\p{So}\p{Sk}\p{Cn}…]*")
_CASED = regex.compile(r"[\p{Lu}\p{Ll}\p{Lt}]")
_THAI = regex.compile(r"[ก-๛]")
_GOES_ON = re.compile(r"\.\s+(?=[^\W\d_A-Z]|[,;])")
_NUMERAL = regex.compile(r"\p{N}|[IVXLCDM]+\b(?!['’])")
_NAME = regex.compile(r"\p{Lu}[\p{L}\p{M}]+")
_LED = regex.compile(r"(?:At|By|On|Around|About|Before|After|Until|Till|Since|From|Towards?|Shortly|Just|Exactly|Gegen|Um|Vers|À)\s(?:\S+\s+){0,5}$")
_CLAUSE_END = regex.compile(r"[.!?…؟।。！？｡\n]|$")


def _word_before(text: str, begin: int, end: int) -> str:
    """The word, with periods within it, that ends at ``end`` and starts at ``begin`` or later; of any length."""
    at = end
    while at > begin and ((c := text[at - 1]).isalpha() or c == "." or c > "\u02ff" and category(c)[0] == "M"):
        at -= 1
    word = text[at:end]
    return "" if word[-1:] == "." else word.rpartition("..")[2].lstrip(".")


def _shortened(text: str) -> set[str]:
    """Words of ``text`` with a period before a small letter or a comma; parts after a period within have two letters at most."""
    out = set()
    for m in _GOES_ON.finditer(text):
        if text[m.end()] in ",;" or category(text[m.end()]) == "Ll":
            word = _word_before(text, 0, m.start())
            first, _, rest = word.partition(".")
            if word and text[m.start() - len(word) - 1 : m.start() - len(word)] != "." and all(len(x) < 3 and x.isalpha() for x in rest.split(".") if rest):
                out.add(word)
    return out


def _number_before(text: str, begin: int, end: int) -> int:
    """Where the number that ends at ``end`` starts; ``end`` if there is none."""
    at = end
    while at > begin and ((c := text[at - 1]).isdigit() or c in ".,:" or c > "\x7f" and category(c)[0] == "N"):
        at -= 1
    while at < end and text[at] in ".,:":
        at += 1
    return at


def _key(token: str) -> str:
    return token.lower() if token.isascii() else default_form()(token).lower()


def _seen_plain(text: str, word: str) -> bool:
    """Whether ``text`` has ``word`` without a period: in small letters, or as a name amid a sentence."""
    small, at = word.islower(), text.find(word)
    while at >= 0:
        end = at + len(word)
        ahead, after = text[at - 1] if at else " ", text[end : end + 2]
        if after and not (ahead.isalnum() or ahead in ".'’-") and (after[0].isspace() or after[0] in ",;:"):
            if small:
                return True
            # before another capital it may be a title written without its period
            if _amid(text, at) and (after[0] in ",;" or after[1:].islower()):
                return True
        at = text.find(word, end)
    return False


def _amid(text: str, at: int) -> bool:
    """Whether what starts at ``at`` follows a small letter or a comma and a blank."""
    return at > 1 and text[at - 1] == " " and (text[at - 2].islower() or text[at - 2] in ",;")


class Splitter:
    """Finds where sentences start; ``medial`` holds the corpus's own abbreviations, ``ordinary`` the listed words it uses as words."""

    def __init__(self, medial: frozenset[str] = frozenset(), ordinary: frozenset[str] = frozenset()) -> None:
        self.medial = {_key(x) for x in MEDIAL} | medial
        self.ordinary = ordinary - medial
        self.here: frozenset[str] | set[str] = frozenset()
        self.names: frozenset[str] | set[str] = frozenset()
        self.final = {_key(x) for x in FINAL}

    def starts(self, text: str | None, here: frozenset[str] | set[str] = frozenset(), names: frozenset[str] | set[str] = frozenset()) -> list[int]:
        """Offsets of the first visible character of every sentence, the first included.

        A null, empty or blank text has none. What stands between two offsets, white
        space included, is one sentence: nothing is lost. ``here`` holds abbreviations
        and ``names`` names that the text's document or corpus tell of.
        """
        self.here, self.names = here, names
        if not text or text.isspace():
            return []
        if not text.isascii() and _INVISIBLE.search(text):
            where = [i for i, ch in enumerate(text) if not _INVISIBLE.match(ch)]
            if not where:
                return [len(text) - len(text.lstrip())]
            return [where[i] for i in self._starts("".join([text[i] for i in where]))]
        return self._starts(text)

    def _starts(self, text: str) -> list[int]:
        n, cuts = len(text), []
        begin = quotes = seen = 0
        own: set[str] | None = None
        while begin < n and text[begin].isspace():
            begin += 1
        first = begin
        for m in _MARKS.finditer(text, first):
            if m.start() < begin:
                continue
            mark, end = m.group(), m.end()
            if mark[0] == "\n":
                at = self._visible(text, end)
                if at < n:
                    cuts.append(at)
                    begin, quotes, seen = at, 0, at  # a quotation left open ends with its paragraph
                continue
            if end >= n:
                break
            # the closing quotes and brackets that follow
            quotes += text.count('"', seen, m.start())
            seen = m.start()
            closed, at = False, end
            while at < n:
                ch = text[at]
                if ch in _CLOSE or ch == '"' and (quotes + text.count('"', seen, at)) % 2 or ch == "“" and text.rfind("„", begin, at) > text.rfind("“", begin, at) or ch in "'’" and (at + 1 == n or not text[at + 1].isalnum()):
                    closed, at = closed or ch not in ")]）】", at + 1
                elif ch in _NARROW and at + 1 < n and text[at + 1] in "»›":
                    at += 1
                else:
                    break
            nxt = self._visible(text, at)
            if nxt >= n:
                break
            if self._ends(text, begin, m.start(), mark, at, nxt, closed, lambda: own):
                if mark == "." and own is None:
                    own = {_key(w) for w in _shortened(text) if not _seen_plain(text, w)}  # the text's own evidence
                    if own and not self._ends(text, begin, m.start(), mark, at, nxt, closed, lambda: own):
                        continue
                cuts.append(nxt)
                begin = nxt
                quotes += text.count('"', seen, nxt)
                seen = nxt
        if (thai := len(_THAI.findall(text))) and 2 * thai > sum(map(str.isalpha, text)):
            cuts = sorted({*cuts, *self._thai(text, first)})
        return [first, *cuts] if first < n else []

    @staticmethod
    def _visible(text: str, at: int) -> int:
        n = len(text)
        while at < n and text[at].isspace():
            at += 1
        return at

    def _ends(self, text: str, begin: int, at_mark: int, mark: str, at: int, nxt: int, closed: bool, own: Callable) -> bool:
        """Whether the mark at ``at_mark``, with its closing signs up to ``at``, ends a sentence before ``nxt``."""
        if text[nxt] in ",;:，、；：،؛":
            return False  # the sentence goes on
        spaced = nxt > at
        head = _OPEN.match(text, nxt).end()
        opened = head > nxt
        follow = text[head] if head < len(text) else ""
        cased = bool(_CASED.match(follow)) if follow else False
        before = text[at_mark - 1] if at_mark else ""
        if mark[0] in _EAST_MARKS or mark[-1] in _EAST_MARKS:
            if closed:
                return self._quoted_caseless(text, at, nxt, spaced)
            return True
        if cased and follow.islower():
            return False
        pause = mark[0] == "…" or mark.startswith("..")
        if pause and not cased:
            return opened and spaced and not follow.isdigit() and bool(follow)
        if mark == ".":
            if not spaced and not closed:
                # the next sentence without a space, not a file, site, version or initials
                if follow.isdigit() and not opened or not before.isalnum() and before not in "”\"»)%":
                    return False
                if opened:
                    return text[nxt] not in "-_#*>'’" and (follow.isupper() or not cased and follow.isalpha())
                if not cased:
                    return follow.isalpha() and before.isalpha() and not _CASED.match(before)
                word = _word_before(text, begin, at_mark)
                return (len(word) > 1 and "." not in word or before.isdigit()) and head + 1 < len(text) and text[head + 1].islower() and _key(word) not in self.medial and _key(word) not in self.here
            if not closed:
                if before.isdigit():
                    return self._after_number(text, begin, at_mark, follow, cased)
                if word := _word_before(text, begin, at_mark):
                    key = _key(word)
                    if key in self.final:
                        return not follow.isdigit() and not (_LED.match(text[begin : at_mark - len(word)]) and self._name(text, head))
                    if key in (own() or ()):
                        return False
                    if key in self.medial or key in self.here:
                        return self._ordinary(text, word, key, head)
                    if len(word) == 1 and _CASED.match(word) or "." in word and all(len(x) == 1 for x in word.split(".")):
                        return False
        if closed and (mark != "." or not cased):
            if cased:
                return not _ATTRIBUTION.match(text, head) if not opened else True
            if follow.isalpha():
                return self._quoted_caseless(text, at, nxt, spaced)
        if not spaced and not closed and mark != ".":
            return opened or follow.isupper() or bool(follow) and not cased and follow.isalpha()
        return bool(follow) or opened

    def _ordinary(self, text: str, word: str, key: str, head: int) -> bool:
        """Whether ``word``, an abbreviation elsewhere, is a word of its own before what starts at ``head``."""
        if _NUMERAL.match(text, head):
            return False
        return _seen_plain(text, word) or word.islower() and (key in self.ordinary and key not in self.here or word in NUMBERED)

    def _name(self, text: str, head: int) -> bool:
        """Whether the word at ``head`` is a name: capitalised amid a sentence elsewhere in the document, never in small letters."""
        m = _NAME.match(text, head)
        if not m:
            return False
        if _key(m.group()) in self.names:
            return True
        word = regex.escape(m.group())
        return any(_amid(text, x.start()) for x in regex.finditer(rf"\b{word}\b", text) if x.start() != head) and not regex.search(rf"\b{word.lower()}\b", text)

    def _after_number(self, text: str, begin: int, at_mark: int, follow: str, cased: bool) -> bool:
        start = _number_before(text, begin, at_mark)
        if not text[begin:start].strip(" \t([") or at_mark - start <= 4 and self._opens_line(text, start):
            return False  # the number of a list item
        words = text[begin:start].rsplit(None, 1)
        return not (words and words[-1].lower() in _ORDINAL_BEFORE and cased and at_mark - start <= 2)

    @staticmethod
    def _opens_line(text: str, at: int) -> bool:
        """Whether nothing but blanks and a bracket stand before ``at`` in its line."""
        if at and text[at - 1] in "([":
            at -= 1
        while at and text[at - 1].isspace() and text[at - 1] != "\n":
            at -= 1
        return not at or text[at - 1] == "\n"

    @staticmethod
    def _quoted_caseless(text: str, at: int, nxt: int, spaced: bool) -> bool:
        """After a closed quotation in a script without case: not before the words that say who speaks."""
        clause = text[nxt : _CLAUSE_END.search(text, nxt).start()]
        return not _CASELESS_SAYS.search(clause) or clause[:1] in "“「『«\"‘"

    @staticmethod
    def _thai(text: str, first: int) -> list[int]:
        out = []
        for m in regex.finditer(r"\s+", text, pos=first):
            a, b = m.span()
            if b >= len(text) or not a:
                continue
            if not (_THAI.match(text[a - 1]) or _THAI.match(text[b])):
                continue
            if text[b].isdigit() or text[a - 1].isdigit() or _number_before(text, first, a - 1) < a - 1 and text[a - 1] in ".)%:":
                continue
            out.append(b)
        return out


def _visible_text() -> Column:
    return F.when(F.octet_length("text") == F.char_length("text"), F.col("text")).otherwise(F.regexp_replace("text", _INVISIBLE.pattern.replace(r"\U000e0000-\U000e01ef", r"\x{e0000}-\x{e01ef}"), ""))


#: Evidence up to this many rows is sent to every task, beyond it is joined to the texts by word; results are the same.
SHARED = 100_000
_HIT = r"(?<![\p{L}\p{M}.])[\p{L}\p{M}]++(?:\.\p{L}{1,2})*\.\s+[\p{L}\p{N},;][\p{L}\p{M}]*"


def _sites(texts: DataFrame) -> DataFrame:
    """(kind, doc, word, n, inside): what stands around the periods of ``texts`` (doc, text), counted.

    Kind `w` is a word before a period in the corpus, ``inside`` how often a small
    letter or a number follows; `d` a word, not of the list, that a document has before
    a small letter or comma; `n` a capitalised word after an abbreviation that may end
    a sentence. Sums are made before the shuffle; only `d` and `n`, which are few, grow
    with the documents.
    """
    hit = texts.select("doc", F.explode(F.regexp_extract_all(_visible_text(), F.lit(_HIT), F.lit(0))).alias("hit"))
    follow = F.regexp_extract("hit", r"[\p{L}\p{N},;][\p{L}\p{M}]*$", 0)
    hit = hit.select("doc", F.lower(F.expr("left(hit, length(hit) - length(substring_index(hit, '.', -1)) - 1)")).alias("word"), follow.alias("follow"))
    small = F.col("follow").rlike(r"^\p{Ll}")
    inside = small | F.col("follow").rlike(r"^\p{N}")
    amid = small | F.col("follow").isin(",", ";")
    listed = F.col("word").isin(*sorted({x.lower() for x in [*MEDIAL, *FINAL]}))
    none = F.lit(None).cast("string")
    site = lambda kind, doc, word: F.struct(F.lit(kind).alias("kind"), doc.alias("doc"), word.alias("word"))
    every = site("w", none, F.col("word"))
    own = F.when(amid & ~listed & F.col("doc").isNotNull(), site("d", F.col("doc"), F.col("word")))
    name = F.when(F.col("word").isin(*FINAL) & F.col("follow").rlike(r"^\p{Lu}[\p{L}\p{M}]") & F.col("doc").isNotNull(), site("n", F.col("doc"), F.lower("follow")))
    each = hit.select(inside.cast("int").alias("inside"), F.explode(F.array_compact(F.array(every, own, name))).alias("s"))
    return each.groupBy("s.kind", "s.doc", "s.word").agg(F.count("*").alias("n"), F.sum("inside").alias("inside"))


def _sure_words(counts: DataFrame, least: int) -> DataFrame:
    """(word, key) of the words of ``counts`` (word, n, inside) that nearly always stand within a sentence."""
    arrow = pa.schema([("word", pa.string()), ("key", pa.string()), ("sure", pa.bool_())])
    sure = (F.col("inside") >= least) & (F.col("inside") >= 0.98 * F.col("n"))

    def make():
        return lambda c: {"word": c["word"], "key": [_key(w) for w in c["word"]], "sure": c["sure"]}

    keyed = map_columns(counts.select("word", sure.alias("sure")), make, "word string, key string, sure boolean", arrow)
    # look-alikes of a sure word are it too
    return keyed.withColumn("sure", F.max("sure").over(Window.partitionBy("key"))).filter("sure").select("word", "key")


def abbreviation_table(texts: DataFrame, least: int = 5) -> DataFrame:
    """(word, key) of words that nearly always stand before a period within a sentence, over all of ``texts``.

    Words of any length and any number of them: a table, decided by the evidence of each alone.
    """
    return _sure_words(_sites(texts.select(F.lit(None).cast("string").alias("doc"), "text")).filter("kind = 'w'"), least)


def corpus_abbreviations(texts: DataFrame, least: int = 5) -> frozenset[str]:
    """The keys of ``abbreviation_table``, gathered: for small corpora and single texts."""
    return frozenset(r["key"] for r in abbreviation_table(texts, least).select("key").distinct().collect())


def evidence(texts: DataFrame, least: int = 5) -> DataFrame:
    """(doc, word, key, kind): what documents and corpus tell of their words, over all of ``texts`` (doc, text).

    Kind `abbr` with a document: the document has the word before a small letter or
    comma, and never without a period in small letters or amid a sentence. Kind `abbr`
    with a null document: the corpus nearly always has it within a sentence. Kind
    `name`: the document has it capitalised amid a sentence and never in small letters;
    only names that follow an abbreviation are asked for. Texts of a null document
    tell nothing about each other.
    """
    sites = checkpointed(_sites(texts))
    sure = checkpointed(_sure_words(sites.filter("kind = 'w'"), least))
    asked = checkpointed(sites.filter("kind <> 'w'").select("doc", "word", "kind").join(sure.select("word"), "word", "left_anti"))
    few = F.broadcast if asked.count() <= SHARED else lambda df: df  # else Spark chooses
    # where those documents have the words amid sentences: unambiguous occurrences elsewhere
    small = F.regexp_extract_all(_visible_text(), F.lit(r"(?<![\p{L}\p{M}.'’-])\p{Ll}[\p{L}\p{M}]*+(?=[\s,;:])"), F.lit(0))
    capital = F.regexp_extract_all(_visible_text(), F.lit(r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}\p{M}]*+(?=[\s,;:])"), F.lit(0))
    rows = texts.join(few(asked.select("doc").distinct()), "doc", "left_semi")
    seen = rows.select("doc", F.explode(F.array_distinct(F.concat(small, capital))).alias("as")).select("doc", F.lower("as").alias("word"), (F.lower("as") == F.col("as")).alias("small"))
    how = seen.join(few(asked.select("doc", "word").distinct()), ["doc", "word"], "left_semi").groupBy("doc", "word").agg(F.max("small").alias("small"), F.min("small").alias("only"))
    told = asked.join(how, ["doc", "word"], "left").filter("kind = 'd' AND small IS NULL OR kind = 'n' AND NOT small")
    of_docs = told.select("doc", "word", F.col("word").alias("key"), F.when(F.col("kind") == "d", "abbr").otherwise("name").alias("kind"))
    return of_docs.unionByName(sure.select(F.lit(None).cast("string").alias("doc"), "word", "key", F.lit("abbr").alias("kind")))


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (src, row_id, doc, text) with ``here`` and ``names``: what ``known`` tells of the words of each, null for nothing."""
    words = F.regexp_extract_all(F.lower(_visible_text()), F.lit(r"([\p{L}\p{M}]++(?:\.[\p{L}\p{M}]+)*)\."), F.lit(1))
    after = F.regexp_extract_all(F.lower(_visible_text()), F.lit(r"\.\s+[^\p{L}\p{N}]*([\p{L}\p{M}]+)"), F.lit(1))
    met = rows.select("src", "row_id", "doc", F.explode(F.array_distinct(F.concat(words, after))).alias("word"))
    told = met.join(known.filter("doc IS NULL").drop("doc"), "word").unionByName(met.join(known.filter("doc IS NOT NULL"), ["doc", "word"]))
    # rows of one id share a set, each then finds in it what it has
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("key")))
    sets = told.groupBy(F.col("src").alias("_src"), F.col("row_id").alias("_row")).agg(of("abbr").alias("here"), of("name").alias("names"))
    return rows.join(sets, F.col("src").eqNullSafe(F.col("_src")) & F.col("row_id").eqNullSafe(F.col("_row")), "left").select("src", "row_id", "doc", "text", "here", "names")


def corpus_words(texts: DataFrame, least: int = 5) -> frozenset[str]:
    """Words of the list that ``texts`` use as ordinary words: in small letters, nearly never with a period within a sentence."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(w for w in MEDIAL if len(w) > 1 and w.isalpha()):
        by_first.setdefault(w[0], []).append(w[1:])
    listed = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_first.items())  # by first letter: one look a word
    pattern = rf"(?<![\p{{L}}\p{{M}}.'’-])(?:{listed})(?:\.\s+\p{{Ll}}|[\s,;:])"
    hit = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hit"))
    short = F.col("hit").contains(".").cast("int")
    counts = hit.groupBy(F.regexp_extract("hit", r"^[\p{L}\p{M}]+", 0).alias("word")).agg(F.count("*").alias("n"), F.sum(short).alias("short"))
    found = counts.filter((F.col("n") - F.col("short") >= least) & (F.col("short") <= 0.02 * F.col("n")))
    return frozenset(_key(r["word"]) for r in found.select("word").collect())


_ARROW = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("sent_no", pa.int32()), ("sent_start", pa.int32()), ("sent_end", pa.int32())])


def sentence_spans(df: DataFrame, medial: frozenset[str] | None = None, shared: int = SHARED) -> DataFrame:
    """(src, row_id, sent_no, sent_start, sent_end) of ``df`` (src, row_id, text, and doc where it is known).

    The spans of a text follow each other from its first visible character to its
    end. Null, empty and blank texts have no sentence; repeated rows repeat. Rows of one
    ``doc`` are one document: what one says about an abbreviation or a name holds for
    all. Without ``doc``, or where it is null, a row is a document of its own.
    """
    doc = F.col("doc").cast("string") if "doc" in df.columns else F.lit(None).cast("string")
    rows = df.select("src", "row_id", doc.alias("doc"), "text")
    corpus, of_doc, words = medial or frozenset(), {}, frozenset()
    if medial is None:
        known = checkpointed(evidence(rows.select("doc", "text")))
        words = corpus_words(rows)
        if known.count() <= shared:
            for r in known.collect():
                if r["doc"] is None:
                    corpus |= {r["key"]}
                else:
                    of_doc.setdefault(r["doc"], (set(), set()))[r["kind"] == "name"].add(_key(r["key"]))
        else:
            rows = _joined(rows, known)

    def make():
        split = Splitter(corpus, words).starts

        def run(c):
            out = [[] for _ in _ARROW]
            joined = c.get("here"), c.get("names")
            for src, row, doc, text, here, names in zip(c["src"], c["row_id"], c["doc"], c["text"], joined[0] or repeat(None), joined[1] or repeat(None)):
                if not text:
                    continue
                told = of_doc.get(doc)
                if here or names:
                    told = ({_key(k) for k in here or ()}, {_key(k) for k in names or ()})
                s = split(text, *(told or ()))
                k = len(s)
                out[0] += [src] * k
                out[1] += [row] * k
                out[2] += range(k)
                out[3] += s
                out[4] += s[1:] + [len(text)] * (k > 0)
            return dict(zip(_ARROW.names, out))

        return run

    return map_columns(rows, make, "src string, row_id bigint, sent_no int, sent_start int, sent_end int", _ARROW)


def sentence_at(starts: list[int], offset: int) -> int:
    """Number of the sentence that holds ``offset``."""
    return bisect_right(starts, offset) - 1


def _texts(spark, sf_dir: str, *tags: str) -> DataFrame:
    """Spans, and segments: those of ``tags``, or all; a chapter is a document."""
    seg, span = table(spark, sf_dir, "segments"), table(spark, sf_dir, "spans")
    doc = lambda df: (F.col("item_id") if "item_id" in df.columns else F.lit(None).cast("string")).alias("doc")
    seg = (seg.filter(F.col("tag").isin(*tags)) if tags else seg).select(F.lit("segments").alias("src"), F.col("seg_id").alias("row_id"), doc(seg), "text")
    span = span.select(F.lit("spans").alias("src"), F.col("span_id").alias("row_id"), doc(span), "text")
    return seg.unionByName(span)


def p3_found(spark, sf_dir: str) -> DataFrame:
    return sentence_spans(_texts(spark, sf_dir, "p", "li", "blockquote")).filter("sent_no > 0").select("src", "row_id", "sent_start")


def p3_sentences(spark, sf_dir: str) -> DataFrame:
    return sentence_spans(_texts(spark, sf_dir))


def p3_whole(spark, sf_dir: str) -> DataFrame:
    """Every text put together again from its sentences."""
    texts = _texts(spark, sf_dir)
    met = sentence_spans(texts).join(texts.select("src", "row_id", "text"), ["src", "row_id"])
    piece = F.struct("sent_no", F.expr("substring(text, sent_start + 1, sent_end - sent_start)").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "")
    return met.groupBy("src", "row_id").agg(F.md5(whole).alias("digest"))


QUERIES = {"p3_found": p3_found, "p3_sentences": p3_sentences, "p3_whole": p3_whole}
_BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSEEN = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}"
SQL: dict[str, str] = {
    "p3_whole": f"""SELECT src, row_id, md5(coalesce(nullif(regexp_replace(text, '^[{_BLANK}{_UNSEEN}]+', ''), ''), regexp_replace(text, '^[{_BLANK}]+', ''))) AS digest FROM (SELECT 'segments' AS src, seg_id AS row_id, text FROM segments UNION ALL SELECT 'spans', span_id, text FROM spans) WHERE regexp_matches(text, '[^{_BLANK}]')"""
}
