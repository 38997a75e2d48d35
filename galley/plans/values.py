"""Fixed values of the queries' SQL, written out apart from those of the operators that it checks."""

# White space and scripts as insides of character classes.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RANGES = {
    "han": r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}",
    "kana": r"\x{3040}-\x{30ff}",
    "hangul": r"\x{1100}-\x{11ff}\x{ac00}-\x{d7af}",
    "arabic": r"\x{600}-\x{6ff}",
    "cyrillic": r"\x{400}-\x{4ff}",
    "devanagari": r"\x{900}-\x{97f}",
    "thai": r"\x{e00}-\x{e7f}",
    "latin": "A-Za-z",
}
FOREIGN = "".join(RANGES[s] for s in ("han", "kana", "hangul", "arabic", "cyrillic", "devanagari", "thai"))
# Source languages by script.
SOURCE_LANGUAGE = [
    ("kana", "jpn_Jpan"),
    ("hangul", "kor_Hang"),
    ("han", "zho_Hans"),
    ("arabic", "arb_Arab"),
    ("cyrillic", "rus_Cyrl"),
    ("devanagari", "hin_Deva"),
    ("thai", "tha_Thai"),
]
# Signs of machine translation as expressions, their weights, and whether they are whole words.
ARTEFACTS = [
    ("eyes (flashed|gleamed|narrowed|shone)", 2, False),
    ("the corners of (his|her|their) mouth", 2, False),
    ("could not help but", 2, False),
    ("sucked in a (breath of )?cold air", 2, False),
    ("in the next moment", 1, False),
    ("did not expect that", 1, False),
    ("heaven-defying", 1, False),
    ("said (in a |with a )?(deep|cold|heavy) voice", 1, False),
    ("the youth", 1, True),
    ("jindan|yuan ying|yuanying|zhuji|huashen|lianqi", 2, True),
    ("suddenly discovered", 1, False),
    (r"a look of [^\n]{3,24}(flashed|appeared|crossed)", 1, False),
    ("this (one|daddy) will", 1, True),
    ("very much so", 1, True),
    ("incontinently", 3, True),
    ("the the", 2, True),
    ("already was", 1, True),
    ("was very much", 1, True),
]
# Function words, and contractions that end no sentence.
STOPWORDS = """
a an and are as at be been but by did do does for from had has have he her him his if in into is it its just me my no
not of on or out said she so than that the their them then there these they this those to up us was we were what when
which who with you your
""".split()
DANGLING = ["i'll", "we'll", "he'd", "she'd", "it's"]
# What usable video memory carries.
TIERS = [
    (20000, 32.0, 8192, 2400, 1, "auto"),
    (10500, 14.0, 4096, 1800, 2, "auto"),
    (7000, 8.0, 4096, 1400, 1, "auto"),
    (4500, 7.0, 2048, 1000, 1, "aggressive"),
    (0, 3.0, 2048, 800, 1, "aggressive"),
]
# Replacements of the rule-based rewriter.
PLAIN = [
    ("the the ", "the "),
    ("could not help but smile", "smiled"),
    ("very much so ", ""),
    ("sucked in a cold breath of air", "gasped"),
    ("In the next instant ", "Then "),
    ("suddenly discovered", "found"),
    ("already was", "was already"),
    ("did not expect that", "had not expected that"),
]
# Formats, their other names and suffixes.
FORMATS = ("txt", "md", "html", "json", "jsonl", "epub", "docx", "pdf")
ALIASES = {"text": "txt", "markdown": "md", "htm": "html", "xhtml": "html"}
SUFFIX = {"txt": ".txt", "md": ".md", "html": ".html", "json": ".json", "jsonl": ".jsonl", "epub": ".epub", "docx": ".docx", "pdf": ".pdf"}
