"""Problem 9: what a template, a designer or a server left in place of content.

Labelled exemplars of residue are kept in an inverted index. For each passage (a
paragraph, and its lines) the exemplars that lie in it are retrieved; the share of
the passage's TF-IDF weight that they contain decides. Document frequencies come
from the whole corpus. Code blocks are examples and are not searched.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.session import table

COVER, CONTAINED, FIELD_REACH = 0.8, 0.66, 6
FIELD, VALUE, ID = "\ue000", "\ue001", "\ue002"  # what stands for an unfilled field, an unfilled value, an id
_SIGNS = frozenset((FIELD, VALUE, ID, "9"))

# Labelled exemplars; "support" may stand beside residue but is none alone, of a "pool" any words count.
EXEMPLARS = """
script: please enable javascript to view this chapter
script: please enable javascript to continue using this app
script: javascript is required to read this page
script: javascript is disabled in your browser
script: javascript must be enabled in order for you to use this site
script: you need to enable javascript to run this app
script: you need to activate javascript before the text can be shown
script: we're sorry but the app doesn't work properly without javascript enabled
script: we're sorry but it doesn't work properly without javascript enabled please enable it to continue
script: your browser has scripting disabled the chapter cannot be displayed
script: your browser does not support javascript
script: it looks like scripting is off enable it to continue to
script: turn on js to open
script: turn on javascript to open
script: you have turned off javascript it will not work without it
script: scripts are blocked so it cannot be shown
script: to use allow scripts in your browser
script: needs javascript switch it on and refresh
script: this reader needs scripts to run turn them on in your browser settings and reload
script: this reader needs scripts to run
script: turn them on in your browser settings and reload
script: noscript content is loaded dynamically allow scripts for
script: this site requires javascript and cookies please allow scripts and reload
script: bitte aktivieren sie javascript um dieses kapitel zu lesen
script: veuillez activer javascript pour afficher ce chapitre
script: active javascript en su navegador para leer este capítulo
script: habilite javascript para ver esta página
script: para ver esta página ative o javascript no seu navegador
script: abilita javascript per visualizzare questa pagina
script: для чтения главы включите javascript
script: включите javascript в браузере чтобы продолжить
script: このページを表示するには javascript を有効にしてください
script: 请启用 javascript 后阅读本章
script: 请在浏览器中启用 javascript
script: 이 페이지를 보려면 javascript 를 활성화하세요
script: يرجى تفعيل javascript لعرض هذه الصفحة
script: इस पृष्ठ को देखने के लिए javascript सक्षम करें
script: โปรดเปิดใช้งาน javascript เพื่อดูหน้านี้
error: error 9 this chapter could not be found
error: the page you requested does not exist or has been moved
error: the page you requested could not be found
error: the chapter you are looking for has been removed
error: the page you are looking for is not available
error: is temporarily unavailable 9
error: we could not load right now
error: oops something went wrong while loading this chapter
error: that book is gone or never existed
error: something went wrong please try again
error: an unexpected error occurred while opening the chapter
error: an error occurred while processing your request
error: error establishing a database connection
error: cannot connect to the store connection refused
error: cannot connect to the database
error: document conversion failed unexpected end of file
error: conversion failed
error: fatal error uncaught typeerror in on line 9
error: fatal error uncaught exception in on line 9
error: warning undefined variable in on line 9
error: request timed out after 9 seconds
error: the gateway did not receive a timely response from the upstream server
error: your session has expired please log in again to continue reading
error: you do not have permission to view this chapter
error: access denied you do not have permission to access on this server
error: access denied checking your connection before you proceed
error: access denied
error: checking your connection before you proceed
error: checking your browser before accessing
error: too many requests slow down and try again in 9 minutes
error: too many requests please slow down
error: slow down and try again in 9 minutes
error: site under maintenance we will be back shortly
error: site under maintenance
error: we are down for maintenance
error: error code 9 message chapter not available
error: traceback most recent call last
error: keyerror chapter
error: valueerror
error: typeerror
error: indexerror list index out of range
error: attributeerror nonetype object has no attribute
error: exception in thread main
error: seite nicht gefunden fehler 9
error: fehler 9 seite nicht gefunden
error: erreur 9 une erreur interne est survenue
error: page introuvable
error: error 9 página no encontrada
error: página no encontrada
error: ошибка 9 страница не найдена
error: страница не найдена
error: ページが見つかりません
error: お探しのページは見つかりませんでした
error: 页面不存在或已被删除
error: 找不到页面
error: 服务器错误
error: 페이지를 찾을 수 없습니다
error: الصفحة غير موجودة
error: पृष्ठ नहीं मिला
error: ไม่พบหน้าที่คุณต้องการ
support: please try again later
support: if the problem persists contact the site owner
support: return to the table of contents
support: go back to the home page
support: reload the page
support: request id h
support: reference no h
support: server at port 9
support: server at
support: port 9
support: nginx 9 9
support: nginx like 9 9
support: apache 9 9
support: file line 9 in
support: file line 9 in module
support: return
support: raise
filler: your text goes here
filler: text goes here
filler: add your text here
filler: insert text here
filler: sample text sample text sample text
filler: sample text
filler: this is a placeholder for the translator's note
filler: this is a placeholder
filler: placeholder text
filler: replace this paragraph with your own summary
filler: add a short description of the volume in this box
filler: click here to edit this text
filler: todo write the synopsis
filler: todo
filler: xxxx tbd xxxx
filler: tbd
filler: to be added
filler: to be announced
filler: coming soon
filler: content coming soon
filler: test post please ignore
filler: this is a test
filler: asdf asdf qwer asdf
filler: hier steht später der text des kapitels
filler: text folgt
filler: hier könnte ihr text stehen
filler: texte à venir
filler: votre texte ici
filler: texto de ejemplo
filler: aquí va el texto
filler: текст будет добавлен позже
filler: здесь будет текст
filler: ここにテキストを入力してください
filler: ダミーテキスト
filler: 此处填写正文
filler: 示例文本
filler: 此处填写章节内容
filler: 여기에 텍스트를 입력하세요
pool: lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
pool: sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam est qui dolorem adipisci velit numquam eius modi tempora incidunt magnam aliquam quaerat
pool: at vero eos accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi similique mollitia animi harum quidem rerum facilis expedita distinctio nam libero tempore cum soluta nobis eligendi optio cumque nihil impedit quo minus quod maxime placeat facere possimus assumenda repellendus temporibus autem quibusdam officiis debitis necessitatibus saepe eveniet voluptates repudiandae recusandae itaque earum hic tenetur sapiente delectus reiciendis maiores alias perferendis doloribus asperiores repellat illum fugiat
template: hello f thank you for reading f
template: dear f your chapter f is ready
template: welcome back f
template: the editor of this volume was f who also prepared f
template: posted on f in f
template: you are reading f volume f
template: f by f translated by f
template: copyright f f
template: next chapter f
template: previous f next
template: summary f
template: f
template: chapter v v
template: by v on v v v
template: number of comments v of v
template: total v items v
"""

# What servers give as the reason of a status, and how they word it ("9" is any number).
REASONS = "not found|page not found|forbidden|bad gateway|bad request|unauthorized|internal server error|internal error|gone|gateway timeout|service unavailable|service temporarily unavailable|unavailable|too many requests|request timeout|method not allowed|not implemented".split("|")
_STATUS = ("9 {}", "{} 9", "error 9 {}", "failed to fetch 9 {}", "http 9 9 9 {}", "status 9 reason {} resource")

# How Latin words end; the first alone mark filler, the others go with it.
_LATIN_ENDS = frozenset("um em am im us it at et or ur is nt ae".split())
_LATIN_ALSO = frozenset("as es os".split())

#: Words that say nothing about a passage: articles and what the residue is about.
_SLOTS = frozenset("the a an this our of chapter page book volume site library reader list reading contents table file server resource document x".split())

# Names that templates give their fields.
_NAMES = "author|editor|translator|synopsis|date|title|name|summary|editor|link|first name|last name|book title|chapter title|your name|year|company|city|email"
_F = r"[\p{L}_][\p{L}\p{N}_. ]{0,40}"
_FIELD = regex.compile(
    rf"\{{\{{[^{{}}\n]{{1,60}}\}}\}}|\$\{{[^{{}}\n]{{1,60}}\}}|<%[^%\n]{{1,60}}%>|\[\[{_F}\]\]|\{{%[^%\n]{{1,60}}%\}}|@@{_F}@@|__\p{{L}}[\p{{L}}\p{{N}}_.]{{0,40}}?__"
    rf"|%\p{{L}}[\p{{L}}\p{{N}}_.]{{1,40}}%|\#\p{{L}}[\p{{L}}\p{{N}}_.]{{1,40}}\#|\$\p{{L}}[\p{{L}}\p{{N}}_.]{{1,40}}\$|&(?!amp;|lt;|gt;|quot;|nbsp;|apos;)\p{{L}}[\p{{L}}\p{{N}}_.]{{1,40}};|\{{\p{{L}}[\p{{L}}\p{{N}}_.]{{1,40}}\}}"
    rf"|<{_F} goes here>|\[INSERT {_F} HERE\]|\[(?i:{_NAMES})\]|\[\p{{L}}+[_.]\p{{L}}[\p{{L}}_.]*\]|«(?i:{_NAMES})»|«\p{{L}}+[_.]\p{{L}}[\p{{L}}_.]*»"
)
_VALUE = regex.compile(r"\bundefined\b|\bNaN\b|\bnull\b|\[object Object\]|%[sd]\b")
_FIELD_SIGN = re.compile(r"[{\[<%@#$&«_]")
_HEX = regex.compile(r"\b(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{6,}\b")
_TOKEN = regex.compile(r"[\ue000-\ue002]|[\p{L}\p{M}](?:[\p{L}\p{M}'’]*[\p{L}\p{M}])?|\p{N}+")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]{2,}")
_HOST = regex.compile(r"(?<![\w./])/?[\w-]+(?:[./][\w-]+)*\.\p{Ll}[\w-]*(?!\w)|(?<!\S)/\w[\w/.-]*")
_PATH_AT = re.compile(r"\.[^\W\d_]|/\w")
_HEX_AT = re.compile(r"\d[a-f]|[a-f]\d")
_DIGITS = re.compile(r"\d+")
_SPELT = re.compile(r"[^\W\d_]+(?:['’]+[^\W\d_]+)*")
#: Signs of which ``_SPELT`` and ``_TOKEN`` may make different words: combining marks, scripts without blanks, odd numbers.
_ODD = re.compile("[^\x00-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u02c1\u0370-\u0373\u0376-\u0482\u048a-\u052f\u2000-\u206f\u20a0-\u20bf\u2122]")
_QUOTED = "\"'`“”‘’「」"
_BLANK = regex.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
_LINE = regex.compile(r"\r\n|\n|\r")
_FENCE = regex.compile(r"^[^\S\n]*(```|~~~).*?(?:^[^\S\n]*\1[^\S\n]*$|\Z)", regex.M | regex.S)


def _field(m: regex.Match) -> str:
    a, b, s = m.start(), m.end(), m.string
    quoted = a and s[a - 1] in _QUOTED and b < len(s) and s[b] in _QUOTED
    return " " if quoted else f" {FIELD} "


def _without_paths(text: str, sign: str) -> str:
    """``text`` with ids as ``sign`` and hosts, files and paths as x; only what stands around a dot or slash is looked at."""
    if _HEX_AT.search(text):
        text = _HEX.sub(sign, text)
    out, at, n = [], 0, len(text)
    for m in _PATH_AT.finditer(text):
        a, b = m.span()
        if a < at:
            continue
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        out += (text[at:a], _HOST.sub(" x ", text[a:b]))
        at = b
    return "".join(out) + text[at:] if out else text


def _marked(passage: str) -> str:
    """``passage`` with one sign for each field, unfilled value and id, and x for paths."""
    if _FIELD_SIGN.search(passage):
        passage = _FIELD.sub(_field, passage)
    return _without_paths(_VALUE.sub(f" {VALUE} ", passage), f" {ID} ")


def tokens(passage: str) -> list[str]:
    """Words of a passage; fields, unfilled values and ids become one sign each."""
    return _words(_marked(passage))


def _words(marked: str) -> list[str]:
    out = []
    for w in _TOKEN.findall(marked.lower()):
        if w.isdigit():
            out.append("9")
        elif not w.isascii() and _EAST.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w.replace("’", "'"))
    return out


def _latin(word: str) -> bool:
    """Whether ``word`` ends as a Latin word may."""
    return word[-2:] in _LATIN_ENDS or word[-1:] in "aoie" or word[-2:] in _LATIN_ALSO


#: Chunks between blanks up to this length are remembered, so many at a time: work saved, no result changed.
_CHUNK, _CHUNKS = 40, 200_000


class Index:
    """The exemplars by word, with weights from document frequencies."""

    def __init__(self, frequency: dict[str, int] | None = None, n_docs: int = 0) -> None:
        self.exemplars: list[tuple[str, frozenset[str]]] = []
        for line in [*EXEMPLARS.strip().splitlines(), *(f"error: {form.format(x)}" for x in REASONS for form in _STATUS)]:
            kind, _, text = line.partition(": ")
            text = " ".join({"f": FIELD, "v": VALUE, "h": ID}.get(w, w) for w in text.split())
            self.exemplars.append((kind, frozenset(tokens(text)) - _SLOTS))
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, (_, words) in enumerate(self.exemplars):
            for w in words:
                self.postings[w].append(i)
        self.vocabulary = frozenset(self.postings)
        self.memory: dict[str, tuple[int, int, int, int]] = {}
        self.pool = frozenset().union(*(words for kind, words in self.exemplars if kind == "pool"))
        frequency = frequency or {}
        self.most = 1 + math.log(n_docs + 1)
        self.weight = {w: 1 + math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in self.vocabulary}
        self.weight |= dict.fromkeys(_SLOTS, 0.0) | dict.fromkeys(_SIGNS, 1.0)
        self.total = [sum(self.weight[w] for w in words) for _, words in self.exemplars]
        self.signs = [words & _SIGNS for _, words in self.exemplars]
        self.words = self.vocabulary | _SLOTS | {"undefined", "nan", "null", "object"}

    def _counts(self, chunk: str) -> tuple[int, int, int, int]:
        """Of a chunk without blanks: its words, those of exemplars and signs, the Latin-like ones, those of a pool."""
        if _ODD.search(chunk):
            words = tokens(chunk)
            signs = sum(map(_SIGNS.__contains__, words))
        else:
            plain = _without_paths(chunk, " 9 ")
            words = _SPELT.findall(plain.lower().replace("’", "'"))
            signs = len(_DIGITS.findall(plain))
        known = sum(map(self.words.__contains__, words)) + signs
        return len(words), known, sum(w in self.pool or w[-2:] in _LATIN_ENDS for w in words), sum(map(self.pool.__contains__, words))

    def _sums(self, passage: str) -> tuple[int, int, int, int]:
        """``_counts`` of all chunks of ``passage``; those of short chunks are remembered."""
        n = known = latin = pool = 0
        memory = self.memory
        for chunk in passage.split():
            c = memory.get(chunk)
            if c is None:
                c = self._counts(chunk)
                if len(chunk) <= _CHUNK:
                    if len(memory) >= _CHUNKS:
                        memory.clear()
                    memory[chunk] = c
            n += c[0]
            known += c[1]
            latin += c[2]
            pool += c[3]
        return n, known, latin, pool

    @staticmethod
    def _enough(n: int, known: int, latin: int, pool: int) -> bool:
        """Whether a passage of these sums may be residue.

        A word of no exemplar weighs as much as any word can, so what ``residue`` accepts
        without a field has at most (1 - COVER) / COVER of them to each other word, or is
        filler, whose words of a pool and Latin-like ones are half of it.
        """
        return COVER * (n - known) <= (1 - COVER) * known + 1e-6 or pool > 0 and 2 * latin >= n

    @staticmethod
    def _has_field(passage: str) -> bool:
        return bool(_FIELD_SIGN.search(passage)) and ("[object" in passage or bool(_FIELD.search(passage)))

    def may_be(self, passage: str) -> bool:
        """False where too few words are any exemplar's for ``passage`` to be residue: the usual case, told cheaply."""
        return self._enough(*self._sums(passage)) or self._has_field(passage)

    def _mock_latin(self, seq: list[str]) -> set[str]:
        """The Latin-like words of a passage that is mostly such words, with some of a pool among them; else none.

        Filler goes on in words that no list has: of a pool the endings count beside the words.
        """
        words = [w for w in seq if w not in _SIGNS]
        strong = [w for w in words if w in self.pool or len(w) > 3 and w[-2:] in _LATIN_ENDS and w.isascii()]
        if len(words) < 4 or 2 * len(strong) < len(words) or not any(len(w) > 3 for w in self.pool.intersection(strong)):
            return set()
        return {*strong, *(w for w in words if len(w) > 3 and _latin(w))}

    def residue(self, passage: str) -> str | None:
        """The kind of residue that ``passage`` consists of, or None."""
        seq = tokens(passage)
        known = self.vocabulary.intersection(seq)
        if not known - _SIGNS and FIELD not in known and VALUE not in known:
            return None
        inside: dict[int, float] = defaultdict(float)
        for w in known:
            for i in self.postings[w]:
                inside[i] += self.weight[w]
        covered, kinds = set(), defaultdict(float)
        if mock := self._mock_latin(seq):
            covered |= mock
            kinds["filler"] += self.most
        for i, got in inside.items():
            kind, words = self.exemplars[i]
            if kind == "pool":
                if len(words & known) >= min(4, len(set(seq))):
                    covered |= words
                    kinds["filler"] += got
            elif got >= CONTAINED * self.total[i] > 0 and self.signs[i] <= known:
                covered |= words
                kinds[kind] += got
        sure = [w in covered for w in seq]
        for k, w in enumerate(seq):  # an unfilled field takes the words around it with it
            if w == FIELD:
                kinds["template"] += self.most
                for j in range(max(0, k - FIELD_REACH), min(len(seq), k + FIELD_REACH + 1)):
                    sure[j] = True
        kinds.pop("support", None)
        weights = [self.weight.get(w, self.most) for w in seq]
        whole = sum(weights)
        share = sum(x for x, ok in zip(weights, sure) if ok) / whole if whole else float(all(sure))
        return max(kinds, key=kinds.get) if kinds and share >= COVER else None

    def document(self, text: str | None) -> str | None:
        """The kind of the first paragraph or line of ``text`` that is residue; None for null, empty and blank texts."""
        if not text or text.isspace():
            return None
        if "```" in text or "~~~" in text:
            text = _FENCE.sub("\n\n", text)
        for paragraph in _BLANK.split(text):
            if not paragraph or paragraph.isspace():
                continue
            lines = _LINE.split(paragraph)
            sums = [self._sums(line) for line in lines]
            field = self._has_field(paragraph)
            if (field or self._enough(*map(sum, zip(*sums)))) and (kind := self.residue(paragraph)):
                return kind
            if len(lines) > 1:
                for line, of in zip(lines, sums):
                    if line and (self._enough(*of) or field and self._has_field(line)) and (kind := self.residue(line)):
                        return kind
        return None


class Words:
    """Tells which words of a vocabulary a text has among its ``tokens``."""

    def __init__(self, vocabulary: frozenset[str]) -> None:
        self.vocabulary = vocabulary
        self.memory: dict[str, frozenset[str]] = {}

    def of(self, text: str) -> set[str]:
        """The vocabulary's words in ``text``: by chunks between blanks, once fields and values that hold blanks are marked."""
        if _FIELD_SIGN.search(text):
            text = _FIELD.sub(_field, text).replace("[object Object]", f" {VALUE} ")
        out: set[str] = set()
        memory = self.memory
        for chunk in set(text.split()):
            words = memory.get(chunk)
            if words is None:
                marked = _without_paths(_VALUE.sub(f" {VALUE} ", chunk), f" {ID} ")
                words = self.vocabulary.intersection(_words(marked) if _ODD.search(chunk) else _SPELT.findall(marked.lower().replace("’", "'")))
                if len(chunk) <= _CHUNK:
                    if len(memory) >= _CHUNKS:
                        memory.clear()
                    memory[chunk] = words
            if words:
                out |= words
        return out


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the exemplars occurs, and their number.

    Words are those of the passages, in every script. Only the exemplars' own words
    are counted: a fixed vocabulary, whatever the corpus.
    """
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def make():
        words = Words(Index().vocabulary - _SIGNS)

        def run(c):
            n = Counter()
            for text in c["text"]:
                if text:
                    n.update(words.of(text))
            return {"word": list(n), "n": list(n.values())}

        return run

    hits = map_columns(docs.select("text"), make, "word string, n bigint", arrow)
    return {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.sum("n").alias("n")).collect()}, docs.count()


def with_residue(docs: DataFrame) -> DataFrame:
    """(doc_id, residue) of ``docs`` (doc_id, text): the kind, null where there is none.

    Null, empty and blank texts and an empty table have none; nothing is shuffled but
    the counts of the exemplars' words.
    """
    frequency, n = document_frequencies(docs)
    arrow = pa.schema([("doc_id", pa.int64()), ("residue", pa.string())])

    def make():
        document = Index(frequency, n).document
        return lambda c: {"doc_id": c["doc_id"], "residue": [document(t) for t in c["text"]]}

    return map_columns(docs.select("doc_id", "text"), make, "doc_id bigint, residue string", arrow)


def p9_found(spark, sf_dir: str) -> DataFrame:
    return with_residue(table(spark, sf_dir, "documents")).filter("residue IS NOT NULL").select("doc_id")


def p9_clean(spark, sf_dir: str) -> DataFrame:
    """The documents that stay: those without residue."""
    docs = table(spark, sf_dir, "documents")
    return with_residue(docs).filter("residue IS NULL").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_clean": p9_clean}
SQL: dict[str, str] = {}
