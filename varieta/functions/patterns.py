"""Fixed values shared by the Spark expressions and the SQL oracle.

Every pattern below is written once, in a spelling that the JVM regex engine
(Spark) and RE2 (DuckDB) read the same way.  Python's ``\\s``/``\\w``/``\\S``
are Unicode-aware, Java's are ASCII unless ``(?U)``, and RE2 has no such
flag — so the classes are spelled out explicitly here instead.
"""

from __future__ import annotations

# --- fixed values: character classes -------------------------------------
# Characters for which Python's str.isspace() is true (what Python's \s
# matches in a str pattern).
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
SPACE = f"[{WS}]"          # Python \s
NON_SPACE = f"[^{WS}]"     # Python \S
WORD = r"[\p{L}\p{N}_]"    # Python \w (letters, numbers, underscore)

# --- fixed values: cleaning patterns (order of use is C1..C8) -------------
URL = f"https?://{NON_SPACE}+|www\\.{NON_SPACE}+"       # C1 (cleaner)
URL_LOOSE = f"http{NON_SPACE}+"                         # C1 variant
CONTRACTION = f"({WORD}+){SPACE}+'({WORD}+)"             # C4 (portable)
# Same matches as CONTRACTION for the JVM engine, without per-word
# backtracking: a match can only start at a word start (a previous match
# always ends at a word end), and giving back word characters can never
# let [whitespace]' match, so the first group may be possessive.
CONTRACTION_JVM = f"(?<![\\p{{L}}\\p{{N}}_])({WORD}++){SPACE}+'({WORD}+)"
GIF = r"(?i)!?\[gif\]\([^)]*\)"                          # C5
LINK = r"\[([^\]]+)\]\([^)]*\)"                          # C6 first rule
DANGLING_LINK = r"\[([^\]]+)\]\("                        # C6 second rule
NEWLINES = r"\n+"                                        # C8
EDGE_SPACE = f"^{SPACE}+|{SPACE}+\\z"                      # Python str.strip()
# The same whitespace set as literal characters (for btrim / trim).
WS_CHARS = ("\t\n\x0b\x0c\r" + "".join(chr(c) for c in range(0x1C, 0x20)) + " \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
NON_ASCII = r"[^\x00-\x7F]"                              # C16

# Bracket pairs handled by C7, in the order they are processed.
BRACKET_PAIRS = (("[", "]"), ("(", ")"), ("{", "}"))

# --- fixed values: emoji code points (C2) --------------------------------
# Characters of the Unicode emoji list, one by one or in its ranges; arrows,
# technical signs and shapes that are no emoji stay.
_EMOJI = (
    r"\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{23CF}"
    r"\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}"
    r"\x{2611}\x{2614}\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}\x{2623}\x{2626}\x{262A}\x{262E}\x{262F}\x{2638}-\x{263A}"
    r"\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}\x{2660}\x{2663}\x{2665}\x{2666}\x{2668}\x{267B}\x{267E}\x{267F}"
    r"\x{2692}-\x{2697}\x{2699}\x{269B}\x{269C}\x{26A0}\x{26A1}\x{26A7}\x{26AA}\x{26AB}\x{26B0}\x{26B1}\x{26BD}\x{26BE}"
    r"\x{26C4}\x{26C5}\x{26C8}\x{26CE}\x{26CF}\x{26D1}\x{26D3}\x{26D4}\x{26E9}\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}"
    r"\x{26FD}\x{2702}\x{2705}\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}"
    r"\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}"
    r"\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}\x{1F0CF}"
    r"\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1E6}-\x{1F1FF}\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}"
    r"\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7EB}\x{1F7F0}"
    r"\x{1F90C}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
)
# A keycap with its key, or an emoji with the selectors, tags and joined
# emoji that follow it; a joiner or selector elsewhere (Indic text) stays.
# Four ranges that hold them all.
EMOJI_TRIGGER = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAFF}]"
EMOJI_SEQUENCE = rf"[0-9#*]\x{{FE0F}}?\x{{20E3}}|[{_EMOJI}](?:[\x{{FE0E}}\x{{FE0F}}\x{{20E3}}\x{{E0020}}-\x{{E007F}}]|\x{{200D}}[{_EMOJI}])*"
# Same matches as EMOJI_SEQUENCE for the JVM engine, which tries the list's
# ranges one after the other: four ranges that hold them all are tried first.
EMOJI_SEQUENCE_JVM = EMOJI_SEQUENCE.replace("|[", f"|(?={EMOJI_TRIGGER})[", 1)

# --- fixed values: text repair subset (C3) -------------------------------
HTML_ENTITIES = (           # applied in this order; &amp; last
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
)
TERMINAL_ESCAPE = r"\x1B\[[0-9;]*[A-Za-z]"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
             ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"),
             ("ﬆ", "st"))
SINGLE_QUOTES = "ʼ‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
LINE_BREAKS = r"\r\n|[\r\x{2028}\x{2029}\x85]"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0E-\x1F\x7F\x{FEFF}]"
# Any character that one of the repair rules would touch (a cheap gate).
REPAIR_TRIGGER = (r"[\x00-\x08\x0B\x0D-\x1F\x7F\x85\x{02BC}\x{2018}-\x{201F}\x{2028}\x{2029}"
                  r"\x{3000}\x{FB00}-\x{FB06}\x{FEFF}\x{FF01}-\x{FF5E}]")
# The same for the JVM engine: printable ASCII is passed over by one range.
REPAIR_TRIGGER_JVM = r"(?![ -~])" + REPAIR_TRIGGER
# Fullwidth forms U+FF01..U+FF5E map one-to-one onto ASCII U+0021..U+007E;
# the ideographic space maps to a plain space.  Built from that rule.
FULLWIDTH_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
FULLWIDTH_TO = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

# Mojibake: UTF-8 bytes read as Latin-1 or its Windows form.  Each rule is
# (lead characters, following characters, what a following one stands for),
# built from the byte ranges of Latin-1 letters and signs (U+00A0..U+00FF) and
# of dashes, quotes, bullet and ellipsis (U+2010..U+2026).


def _read_as_latin(first: int, last: int, shift: int) -> tuple[str, str]:
    """Following characters for the bytes ``first..last`` and their meaning."""
    pairs = [(chr(b), chr(b + shift)) for b in range(first, last + 1)]
    for b in range(first, min(last, 0x9F) + 1):
        windows = bytes([b]).decode("cp1252", "ignore")
        if windows:
            pairs.append((windows, chr(b + shift)))
    return "".join(p for p, _ in pairs), "".join(m for _, m in pairs)


MOJIBAKE = (
    ("\u00c3", *_read_as_latin(0x80, 0xBF, 0x40)),
    ("\u00c2", *_read_as_latin(0xA0, 0xBF, 0)),
    ("\u00e2\u20ac", *_read_as_latin(0x90, 0xA6, 0x2000 - 0x80)),
    ("\u00e2\u0080", *_read_as_latin(0x90, 0xA6, 0x2000 - 0x80)),
)

# --- fixed values: tokenisation and code-mixing detector (C11, M1-M3) ----
TOKEN = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
TOKEN_OR_SYMBOL = TOKEN + f"|[^\\p{{L}}\\p{{N}}_{WS}]"
HINGLISH_SEEDS = (
    "bhai", "bhaiya", "yaar", "paisa", "sarkar", "desh", "dost", "wala", "wali",
    "bakwas", "chutiya", "gaali", "kya", "kyu", "kyun", "haan", "han", "nahi",
    "nahin", "matlab", "jaldi", "abhi", "arre", "arey", "mast", "bindaas",
    "jugaad", "pyaar", "pyar",
)
ROMANISED_MARKERS = ("bh", "kh", "gh", "ch", "jh", "sh", "aa", "ee", "oo", "ai",
                     "au", "ya", "ji")
ROMANISED_ENDINGS = ("wala", "wali", "ji", "na", "haan", "nahin")
ROMANISED_CUE = ("(" + "|".join(ROMANISED_MARKERS) + ")|("
                 + "|".join(ROMANISED_ENDINGS) + ")$")
MIN_ELIGIBLE_LEN = 4
ZIPF_COMMON = 3.5
RATIO_SCALE = 0.30
SWITCH_SCALE = 5.0
RATIO_WEIGHT = 0.7
SWITCH_WEIGHT = 0.3
CM_THRESHOLD = 0.30

# --- fixed values: generation post-processing (C13) ----------------------
POST_STRIP_CHARS = "/\\*?[]{}(),:\"'.`"

# --- fixed values: missing-value tokens read as null at load (T4) --------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
             "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null")


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"
