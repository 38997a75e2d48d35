"""Problem 2: one form for texts that look the same.

Look-alike classes are the transitive closure (union-find) of pairs of strings and
code points, in decomposed form: width, ligature, space and joining variants follow
from the Unicode database, the letters that scripts share and a few sequences from a
table. A class is represented by its most frequent code point in the corpus; an
Aho-Corasick automaton rewrites every other member, longest match first.

One pass settles every text: invisible signs are dropped and the text decomposed
first, representatives are spelt with representatives only, and no pattern holds a
character of another class, so that nothing written can match again.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.session import checkpointed, table

# Letters and signs that are drawn alike, and sequences drawn like one letter.
LOOK_ALIKES = """
Latin: ɡg ɑa
Cyrillic: аa еe оo рp сc уy хx іi јj ѕs һh ӏl ԁd ԛq ԝw ѵv АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ӀI ѴV
Greek: οo νv ρp ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϹC ϳj ͿJ
Armenian: օo սu հh ոn ՕO ՍU
Coptic: ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲬX ⲘM ⲚN ⲎH ⲒI ⲔK ⲂB
Cherokee: ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ
Lisu: ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ
Kana and Han: ニ二 ロ口 ハ八 カ力 エ工 タ夕 ト卜 ヘへ ム厶
Signs: ‐- ‑- ‚, ʼ’ ∕/ ⁄/ ∶: ։: ׃: ∗* ‧· ∙· ⋅· ‒–
Sequences: แเเ आअा ओअो औअौ ऑअॉ ऐएे
"""

#: Characters that leave no mark on the page.
_INVISIBLE = regex.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e01ef]")


def plain(text: str) -> str:
    """``text`` decomposed and without invisible characters."""
    return unicodedata.normalize("NFD", text if text.isascii() else _INVISIBLE.sub("", text))


def _compatible(ch: str) -> str | None:
    """What ``ch`` is a mere variant of by width, space, ligature or joining form."""
    kind, _, rest = unicodedata.decomposition(ch).partition("> ")
    if not kind.startswith("<") or not rest:
        return None
    kind, cat, cp = kind[1:], unicodedata.category(ch), ord(ch)
    if cat == "Zs":
        return " "
    drawn_alike = kind in ("wide", "narrow", "noBreak", "isolated", "initial", "medial", "final")
    joined = kind == "compat" and (cat[0] == "L" or cat == "Nl" or 0x2E80 <= cp <= 0x2FD5)
    variant_letter = cp == 0x17F or 0x3D0 <= cp <= 0x3FF  # long s, Greek letter shapes: drawn differently
    if not (drawn_alike or joined) or variant_letter:
        return None
    return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))


class _Union:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (nxt := self.up.setdefault(root, root)) != root:
            root = nxt
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        if a != b:
            self.up[self.find(a)] = self.find(b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(maxsize=1)
def classes() -> list[list[str]]:
    """The look-alike classes: decomposed strings, each class with two or more.

    A letter with marks is its base letter's look-alikes with the same marks, since
    both are decomposed: no class needs to say so. A string in one class with others
    is spelt with the look-alikes of its own characters alike.
    """
    u = _Union()
    for cp in range(0xA0, 0x1FFFF):
        ch = chr(cp)
        if not 0xD800 <= cp < 0xE000 and not _INVISIBLE.match(ch) and unicodedata.normalize("NFD", ch) == ch and (other := _INVISIBLE.sub("", _compatible(ch) or "")):
            u.join(ch, other)
    for line in LOOK_ALIKES.strip().splitlines():
        for item in line.partition(": ")[2].split():
            u.join(item[0], unicodedata.normalize("NFD", item[1:]))
    return sorted(sorted(c) for c in u.classes().values())


def representatives(frequency: dict[str, int]) -> dict[str, str]:
    """Each member of a class to what represents the class, where they differ.

    ``frequency`` is that of code points in decomposed texts. The most frequent code
    point represents, a combining mark before all (texts have no other when decomposed);
    among equals one that is no compatibility variant, then the lowest. A class that
    holds a string whose characters have look-alikes is spelt by the most frequent such
    string, in the representatives of its characters.
    """
    of = {x: c for c in classes() for x in c}

    def rank(x: str) -> tuple:
        return (-(unicodedata.combining(x[0]) > 0), -min(frequency.get(k, 0) for k in x), unicodedata.normalize("NFKD", x) != x, x)

    known: dict[str, str] = {}

    def best(x: str) -> str:
        c = of.get(x)
        if c is None:
            return x
        if c[0] not in known:
            spelt = [k for k in c if len(k) > 1 and any(ch in of for ch in k)]
            known[c[0]] = min((k for k in c if len(k) == 1), key=rank)  # stands while its own strings are spelt
            if spelt or all(len(k) > 1 for k in c):
                known[c[0]] = "".join(map(best, min(spelt, key=rank)))
        return known[c[0]]

    return {x: r for x in of if (r := best(x)) != x and not (len(x) > 1 and any(ch in of for ch in x))}


#: Words up to this length are remembered with their forms, so many at a time: work saved, no result changed.
_WORD, _WORDS = 40, 200_000


def rewriter(to: dict[str, str]) -> Callable[[str], str]:
    """A function from a text to its form under the representatives ``to``."""
    auto = ahocorasick.Automaton()
    for k, v in to.items():
        auto.add_word(k, (len(k), v))
    auto.make_automaton()
    if any(" " in k for k in to):
        raise ValueError("a pattern with a blank would cross words")
    ascii_stays = not any(k.isascii() for k in to)
    known: dict[str, str] = {}

    def rewritten(text: str) -> str:
        text = plain(text)
        out, at = [], 0
        for end, (n, new) in auto.iter_long(text):
            out += (text[at : end - n + 1], new)
            at = end + 1
        return unicodedata.normalize("NFC", "".join(out) + text[at:])

    def word(w: str) -> str:
        if ascii_stays and w.isascii():
            return w
        if len(w) > _WORD:
            return rewritten(w)
        f = known.get(w)
        if f is None:
            if len(known) >= _WORDS:
                known.clear()
            f = known[w] = rewritten(w)
        return f

    def form(text: str) -> str:
        if ascii_stays and text.isascii():
            return text
        # neither a pattern nor a composition holds a blank: words can be told one by one
        return " ".join(map(word, text.split(" ")))

    form.ascii_stays = ascii_stays
    return form


@lru_cache(maxsize=1)
def default_form() -> Callable[[str], str]:
    """The rewriter without corpus frequencies: the sign that the table's others are drawn like represents, else the lowest plain member."""
    pairs = [x for line in LOOK_ALIKES.strip().splitlines() for x in line.partition(": ")[2].split()]
    return rewriter(representatives({x[1]: 1 for x in pairs if len(x) == 2}))


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def corpus_frequency(texts: DataFrame) -> dict[str, int]:
    """How often each code point of a class occurs in all of ``texts`` (text), decomposed.

    Only the members reach the driver: their number is that of the classes' code
    points, whatever the corpus.
    """
    members = sorted({ord(k) for c in classes() for x in c for k in x})
    arrow = pa.schema([("member", pa.int32()), ("n", pa.int64())])

    def make():
        def run(c):
            n = np.zeros(0x110000, np.int64)
            known = [t for t in c["text"] if t]
            for part in ("".join(t for t in known if t.isascii()), unicodedata.normalize("NFD", "\n".join(t for t in known if not t.isascii()))):
                found = np.bincount(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
                n[: len(found)] += found
            rows = [(x, int(n[x])) for x in members if n[x]]
            return {"member": [x for x, _ in rows], "n": [k for _, k in rows]}

        return run

    counts = map_columns(texts.select("text"), make, "member int, n bigint", arrow)
    return {chr(r["member"]): r["n"] for r in counts.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def uniform(df: DataFrame, frequency: dict[str, int] | None = None) -> DataFrame:
    """(src, row_id, form) of ``df`` (src, row_id, text); a null text keeps a null form.

    Equal-looking texts have equal forms. Empty and blank texts are their own forms
    but for invisible characters and kinds of space.
    """
    to = representatives(corpus_frequency(df) if frequency is None else frequency)
    arrow = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("form", pa.string())])

    def make():
        form = rewriter(to)
        return lambda c: {"src": c["src"], "row_id": c["row_id"], "form": [t if t is None else form(t) for t in c["text"]]}

    return map_columns(df.select("src", "row_id", "text"), make, "src string, row_id bigint, form string", arrow)


def _formed(df: DataFrame) -> DataFrame:
    """(src, row_id, form, raw): digests of form and string of every text that is not blank.

    A text in ASCII is its own form unless an ASCII sign is rewritten, and stays in the JVM.
    """
    to = representatives(corpus_frequency(df))
    raw = F.unhex(F.md5("text"))
    text = F.col("text")
    if rewriter(to).ascii_stays:
        text = F.when(F.octet_length("text") > F.char_length("text"), text)
    arrow = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("form", pa.binary()), ("raw", pa.binary())])

    def make():
        form = rewriter(to)

        def run(c):
            forms = [None if t is None else f for t in c["text"] for f in (None if t is None else form(t),)]
            keep = [f is None or not f.isspace() and f != "" for f in forms]
            digests = [r if f is None else _digest(f) for f, r in zip(forms, c["raw"])]
            pick = lambda v: [x for x, ok in zip(v, keep) if ok]
            return {"src": pick(c["src"]), "row_id": pick(c["row_id"]), "form": pick(digests), "raw": pick(c["raw"])}

        return run

    rows = df.filter(F.col("text").rlike(r"[^\s\x1c-\x1f]")).select("src", "row_id", text.alias("text"), raw.alias("raw"))
    return map_columns(rows, make, "src string, row_id bigint, form binary, raw binary", arrow)


def look_alike_classes(df: DataFrame) -> DataFrame:
    """(src, row_id, form, raw) of the rows whose strings have look-alikes: ``form`` is the class, ``raw`` the string.

    One row a row of ``df`` (src, row_id, text), whatever the number of copies; rows
    whose form only one string has, and null, empty and blank texts, are in no class.
    """
    seen = checkpointed(_formed(df))
    several = seen.groupBy("src", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("src", "form")
    return seen.join(several, ["src", "form"], "left_semi")


def equal_looking(df: DataFrame) -> DataFrame:
    """Pairs (src, id_a < id_b) of rows whose strings differ and look the same.

    The members of ``look_alike_classes``, expanded: through pairs of different strings,
    so that copies of one string never meet each other.
    """
    rows = checkpointed(look_alike_classes(df))
    strings = rows.select("src", "form", "raw").distinct()
    a = strings.withColumnRenamed("raw", "raw_a")
    b = strings.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["src", "form"]).filter("raw_a < raw_b").drop("form")
    first = rows.select("src", F.col("raw").alias("raw_a"), F.col("row_id").alias("a"))
    second = rows.select("src", F.col("raw").alias("raw_b"), F.col("row_id").alias("b"))
    met = pairs.join(first, ["src", "raw_a"]).join(second, ["src", "raw_b"])
    return met.select("src", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def _texts(spark, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "segments").select(F.lit("segments").alias("src"), F.col("seg_id").alias("row_id"), "text")
    term = table(spark, sf_dir, "glossary").select(F.lit("glossary").alias("src"), F.col("term_id").alias("row_id"), F.col("source").alias("text"))
    return seg.unionByName(term)


def p2_found(spark, sf_dir: str) -> DataFrame:
    return equal_looking(_texts(spark, sf_dir))


def p2_forms(spark, sf_dir: str) -> DataFrame:
    return uniform(_texts(spark, sf_dir))


def p2_classes(spark, sf_dir: str) -> DataFrame:
    """The rows with look-alikes, each with the least row of its class and the number of strings in it."""
    rows = look_alike_classes(_texts(spark, sf_dir))
    of = rows.groupBy("src", "form").agg(F.min("row_id").alias("class_id"), F.countDistinct("raw").alias("n_strings"))
    return rows.join(of, ["src", "form"]).select("src", "row_id", "class_id", "n_strings")


QUERIES: dict[str, Callable] = {"p2_found": p2_found, "p2_forms": p2_forms, "p2_classes": p2_classes}

# The SQL has its own tables: what the tables' texts may hold of each kind, as one code point to another.
_KANGXI = [chr(c) for c in range(0x2F00, 0x2FD6)]
_SQL_FROM = "аеорсухіјѕһӏԁАВЕЅІЈКМНОРСТУХҮονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧёїѐѝЁЇЀӑӓӗӧӱӐӒӖӦό" + "口八力工夕卜二" + "".join(_KANGXI)
_SQL_TO = "aeopcyxijshldABESIJKMHOPCTYXYovpABEZHIKMNOPTYXëïèѝËÏÈăäĕöÿĂÄĔÖó" + "ロハカエタトニ" + "".join(unicodedata.normalize("NFKC", c).translate(str.maketrans("口八力工夕卜二", "ロハカエタトニ")) for c in _KANGXI)
_KANA_FROM = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ\uff9e\uff9f"
_KANA_TO = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
_LOOKS = rf"""WITH t AS (SELECT 'segments' AS src, seg_id AS row_id, text FROM segments UNION ALL SELECT 'glossary', term_id, source FROM glossary),
wide AS (SELECT string_agg(chr((65281 + i)::INT), '' ORDER BY i) AS f, string_agg(chr((33 + i)::INT), '' ORDER BY i) AS g FROM range(94) r(i)),
shown AS (SELECT src, row_id, text, nfc_normalize(regexp_replace(text, '[\x{{00AD}}\x{{034F}}\x{{061C}}\x{{115F}}\x{{1160}}\x{{180B}}-\x{{180E}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}]', '', 'g')) AS s FROM t),
kana AS (SELECT src, row_id, text, translate(translate(regexp_replace(s, '[\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), f, g), '{_KANA_FROM}', '{_KANA_TO}') AS s FROM shown, wide),
joined AS (SELECT src, row_id, text, replace(replace(replace(replace(replace(replace(s, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ำ', 'ํา') AS s FROM kana),
forms AS (SELECT src, row_id, text, nfc_normalize(translate(s, '{_SQL_FROM}', '{_SQL_TO}')) AS f FROM joined WHERE trim(s, E' \t\n\r\f\x0b') <> '')"""
SQL: dict[str, str] = {
    "p2_found": _LOOKS + " SELECT a.src, a.row_id AS id_a, b.row_id AS id_b FROM forms a JOIN forms b ON a.src = b.src AND a.f = b.f AND a.text <> b.text AND a.row_id < b.row_id",
    "p2_classes": _LOOKS + ", c AS (SELECT src, f, min(row_id) AS class_id, count(DISTINCT text) AS n_strings FROM forms GROUP BY src, f HAVING count(DISTINCT text) > 1) SELECT src, row_id, class_id, n_strings FROM forms JOIN c USING (src, f)",
}
