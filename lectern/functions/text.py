"""Text cleaning, keys and display forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
APOSTROPHES = "‘’"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII letters, digits and underscore."""
    w = "[A-Za-z0-9_]"
    return pattern.replace("\\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def words(c: Column) -> Column:
    return F.filter(F.split(text(c), SPACE), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def decode_xml(c: Column) -> Column:
    """Entities, the ampersand first."""
    out = text(c)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_xml(c: Column) -> Column:
    return squeeze(decode_xml(F.regexp_replace(text(c), "<[^>]+>", " ")))


def short_cite(c: Column) -> Column:
    """`Name 'YY` from the usual three forms of a citation's beginning; empty for others."""
    value = F.translate(squeeze(c), "’", "'")
    name = "^([A-Z][A-Za-z.\\-]+)"
    forms = (name + "\\s*'(\\d{2})\\b", name + "\\s+(\\d{2}|\\d{4})\\b", name + "\\s+\\d{1,2}\\s*[-/]\\s*\\d{1,2}\\s*[-/]\\s*(\\d{2}|\\d{4})\\b")
    out = F.lit("")
    for form in map(js, reversed(forms)):
        year = F.regexp_extract(value, form, 2)
        out = F.when(value.rlike(form), F.concat(F.regexp_extract(value, form, 1), F.lit(" '"), F.right(year, F.lit(2)))).otherwise(out)
    return out


def has_highlight(markdown: Column) -> Column:
    return text(markdown).contains("==") | text(markdown).contains("<u>") | text(markdown).contains("**")


def _marked(markdown: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text(markdown), F.lit(pattern), F.lit(0))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n)


def highlight_words(markdown: Column) -> Column:
    """Words within <u>..</u> or ==..== spans, taken from left to right."""
    plain = lambda m: F.regexp_replace(F.regexp_replace(m, "<[^>]+>", " "), "[*_=¶]", " ")
    return _total(F.transform(_marked(markdown, "(?s)<u>.*?</u>|==.*?=="), lambda m: n_words(plain(m))))


def highlight_words_nested(markdown: Column) -> Column:
    """Words of == spans and words of underlined spans; what is marked both ways counts twice."""
    bare = lambda m: F.regexp_replace(m, "<[^>]+>", "")
    marked = _total(F.transform(_marked(markdown, "(?s)==.+?=="), lambda m: n_words(bare(F.substring(m, F.lit(3), F.length(m) - 4)))))
    lined = _total(F.transform(_marked(markdown, "(?is)<u\\b[^>]*>.+?</u>"), lambda m: n_words(F.regexp_replace(bare(m), "==+", ""))))
    return marked + lined


def warrant_density(markdown: Column) -> Column:
    """Underlined words over all words, to four places; 0 for an empty text."""
    every = n_words(F.regexp_replace(text(markdown), "[*_=<>/¶]", " "))
    lined = _total(F.transform(_marked(markdown, "(?s)\\*\\*<u>.*?</u>\\*\\*|<u>.*?</u>"), lambda m: n_words(strip_xml(F.replace(m, F.lit("**"), F.lit(" "))))))
    return F.when(every > 0, F.round(lined / every, 4)).otherwise(0.0)


def highlights(markdown: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text(markdown), F.lit("==([^=]+)=="), F.lit(1)), " ")


def strip_marks(markdown: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(text(markdown), "(?i)</?u>", ""), "\\*\\*|==|¶", ""))


def fingerprint(c: Column) -> Column:
    return F.sha1(squeeze(F.lower(text(c))).cast("binary"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the code points, in hexadecimal without leading zeros."""
    codes = F.transform(F.filter(F.split(text(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)))


def team_key(students: Column, school: Column, code: Column) -> Column:
    """Sorted student ids, or else hashes of the school's name and the entry's code."""
    ids = F.array_sort(F.filter(F.transform(students, lambda s: s.cast("string")), lambda s: F.coalesce(s, F.lit("")) != ""))
    hashed = F.concat(F.lit("h:"), fnv1a(F.lower(text(school))), F.lit(":c:"), fnv1a(text(code)))
    return F.when(F.size(F.coalesce(ids, F.array().cast("array<string>"))) > 0, F.concat(F.lit("s:"), F.array_join(ids, ","))).otherwise(hashed)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Fixed values.
TOPIC_ACRONYMS = ("ai", "cp", "da", "nfu", "rvi", "pic", "pics", "us", "uk", "eu", "un", "nato", "ndt", "ceda", "ld", "icj", "icc", "wto", "imf")


#: Letters whose capital has more than one code point, and the one code point that is their simple capital, if there is one.
_LONG = [chr(x) for x in range(0x80, 0x20000) if not 0xD800 <= x < 0xE000 and len(chr(x).upper()) > 1]
_SIMPLE = {x: x.title() if len(x.title()) == 1 else x for x in _LONG} | {"ß": "ẞ"}


def capital(c: Column) -> Column:
    """c with its first code point as its simple capital: one code point, "ẞ" for "ß"."""
    first = F.substring(c, 1, 1)
    one = F.when(first.isin(*_LONG), F.translate(first, "".join(_SIMPLE), "".join(_SIMPLE.values()))).otherwise(F.upper(first))
    return F.concat(one, F.substring(c, F.lit(2), F.length(c)))


def title_case(c: Column) -> Column:
    """Lower case with a capital at each beginning of a run of word characters."""
    runs = F.regexp_extract_all(F.lower(text(c)), F.lit("\\w+|\\W+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def title_case_topic(c: Column) -> Column:
    one = lambda w: F.when(F.lower(w).isin(*TOPIC_ACRONYMS), F.upper(w)).otherwise(title_case(w))
    return F.array_join(F.transform(words(c), one), " ")


def saved_key(tag: Column, cite: Column, body: Column) -> Column:
    part = lambda c: F.lower(F.trim(text(c)))
    return F.concat_ws("||", part(tag), part(cite), F.substring(part(body), 1, 200))


def visible_length(c: Column) -> Column:
    out = text(c)
    for pattern, to in (("!\\[[^\\]]*\\]\\([^)]*\\)", " "), ("data:image/[^;]+;base64,[A-Za-z0-9+/=]+", " "), ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("<[^>]+>", " "), ("[#>*_`|~-]", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.length(squeeze(out)).cast("bigint")


def strip_tournament_prefix(title: Column) -> Column:
    return F.trim(F.regexp_replace(text(title), "^[A-Z0-9]{1,4}---", ""))


def infer_side(title: Column, side: Column) -> Column:
    t = F.lower(text(title))
    return (
        F.when(t.rlike("(^|[^a-z])(aff|1ac|2ac)([^a-z]|$)"), "aff").when(t.rlike("(^|[^a-z])(neg|1nc|2nr|nc|cp|da|k|t|pik|th|phil)([^a-z]|$)"), "neg")
        .when(side == "A", "aff").when(side == "N", "neg").otherwise("aff")
    )


def shorten_name(name: Column, school: Column) -> Column:
    """`School First Last` as `School FL`, where the name begins with the school's."""
    n, s = F.trim(text(name)), F.trim(text(school))
    rest = F.trim(F.substring(n, F.length(s) + 1, F.length(n)))
    parts = words(rest)
    initials = F.upper(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))
    fits = (s != "") & F.startswith(F.lower(n), F.lower(s)) & (F.size(parts) >= 2) & initials.rlike("^[A-Z]{2,6}$")
    return F.when(fits, F.concat_ws(" ", s, initials)).otherwise(n)


def code_of(name: Column) -> Column:
    return F.upper(F.regexp_extract(F.trim(text(name)), "([A-Z][A-Za-z]{1,4})$", 1))


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(words(name), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


#: Other names of a place or bracket round.
PLACE_ALIASES = {
    "RUNOFF": "Doubles", "PARTIAL": "Doubles", "PARTIALS": "Doubles", "SEXTO": "Doubles", "SEXTOS": "Doubles",
    "TRIPLE": "Triples", "TRIPLES": "Triples", "TRIPES": "Triples", "TRIPS": "Triples", "3X": "Triples", "1ST TUTORIAL": "Triples", "1ST TUTO": "Triples", "AWT": "Triples",
    "DOUBLE": "Doubles", "DOUBLES": "Doubles", "DOUBL": "Doubles", "DOUB": "Doubles", "2X": "Doubles", "WAU": "Doubles", "DKB": "Doubles", "DKB TUTO": "Doubles", "DKB TUTORIAL": "Doubles",
    "OCTO": "Octos", "OCTOS": "Octos", "OCT": "Octos", "OCTA": "Octos", "OCTAS": "Octos", "OCTAFINALS": "Octos", "OCTAFINAL": "Octos", "OF": "Octos", "RKR": "Octos", "3RD TUTORIAL": "Octos", "3RD TUTO": "Octos",
    "QUARTER": "Quarters", "QUARTERS": "Quarters", "QUARTE": "Quarters", "QUAR": "Quarters", "QRT": "Quarters", "Q": "Quarters", "QUARTERFINALS": "Quarters", "QF": "Quarters", "PB": "Quarters", "4TH TUTORIAL": "Quarters", "4TH TUTO": "Quarters",
    "SEMI": "Semis", "SEMIS": "Semis", "SEMS": "Semis", "SEM": "Semis", "S": "Semis", "SEMIFINALS": "Semis", "SEMIFINAL": "Semis", "SF": "Semis", "MD": "Semis", "5TH TUTORIAL": "Semis", "5TH TUTO": "Semis",
    "FINAL": "Finals", "FINALS": "Finals", "F": "Finals", "PF EXHIBITION": "Finals",
    "CHAMPION": "1st", "CHAMP": "1st", "WINNER": "1st", "1ST": "1st", "FIRST": "1st",
    "2ND": "2nd", "SECOND": "2nd",
    "3RD": "Semis", "THIRD": "Semis",
}
#: Beginnings of such names, tried in order.
PLACE_PREFIXES = (
    ("SEMIFINA", "Semis"), ("QUARTERF", "Quarters"), ("OCTAFINA", "Octos"), ("OCTOFINA", "Octos"), ("DOUBLEOCT", "Doubles"), ("DOUBLE-OCT", "Doubles"), ("DOUBLES", "Doubles"),
    ("TRIPLE", "Triples"), ("FINAL", "Finals"), ("PARTIAL", "Doubles"), ("SEXTO", "Doubles"), ("DOUBL", "Doubles"), ("OCT", "Octos"), ("TRIP", "Triples"),
)


def ordinal(n: Column) -> Column:
    k = F.abs(n) % 100
    end = F.when(k.between(11, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.coalesce(key, F.lit("")))


def normal_place(place: Column) -> Column:
    s = F.trim(text(place))
    key = F.upper(s)
    out = F.when(s == "", "").when(key.rlike("^PRELIM"), "—").when(lookup(PLACE_ALIASES, key).isNotNull(), lookup(PLACE_ALIASES, key))
    out = out.when(s.rlike("^[0-9]+$"), ordinal(s.try_cast("bigint"))).when(key.rlike("^[0-9]+(ST|ND|RD|TH)$"), F.lower(s))
    for start, name in PLACE_PREFIXES:
        out = out.when(key.startswith(start), name)
    return out.otherwise(s)


def normal_bid(bid: Column) -> Column:
    s = F.trim(text(bid))
    out = F.when(s == "", "")
    for name in ("Full", "Silver", "Ghost", "Partial"):
        out = out.when(F.lower(s).startswith(name.lower()), name)
    return out.otherwise(s)


def round_label(depth: Column, round_type: Column, round_name: Column) -> Column:
    number = F.regexp_extract(text(round_name), "^\\s*([0-9]+)", 1)
    early = F.when(number != "", F.concat(F.lit("R"), number.try_cast("int").cast("string"))).otherwise(round_name)
    return F.coalesce(depth, F.when(round_type.isin("prelim", "highlow"), early).otherwise("Partials"))


def short_cite_display(short: Column, cite: Column) -> Column:
    s = text(cite)
    return F.when(text(short) != "", short).otherwise(F.trim(F.when(F.instr(s, "[") > 1, F.substring_index(s, "[", 1)).otherwise(s)))


def author_year_prefix(cite: Column) -> Column:
    return F.regexp_extract(F.trim(text(cite)), "^([A-Z][A-Za-z.\\-]*(?:\\s+(?:&|and|et al\\.?)\\s*[A-Z]?[A-Za-z.\\-]*)?\\s*[’']?\\d{2,4})", 1)


def clean_author(c: Column) -> Column:
    clean = squeeze(F.regexp_replace(text(c), "(?i)^(by|written by|author[:\\s])\\s*", ""))
    return F.when(clean.rlike("(?i)^(staff|editor|editorial team|admin)$"), "").otherwise(clean)


def last_name(author: Column) -> Column:
    clean = F.trim(F.regexp_replace(text(author), "(?i)^(by|written by)\\s+", ""))
    return F.when(clean.contains(","), F.trim(F.substring_index(clean, ",", 1))).otherwise(F.coalesce(F.try_element_at(words(clean), F.lit(-1)), F.lit("")))


def year_of(date: Column) -> Column:
    return F.substring(F.regexp_extract(text(date), js("\\b(20\\d\\d|19\\d\\d)\\b"), 1), 3, 2)


def title_key(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9 ]+", " "), "\\s+", " ")), 1, 140)


def tag_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9\\s]", " "), "\\s+", " "))


def normal_cite(c: Column) -> Column:
    return squeeze(F.translate(F.lower(text(c)), APOSTROPHES, "''"))


def body_prefix(c: Column) -> Column:
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text(c)), SPACE, " "), "[^a-z0-9 ]", ""), 1, 100))


def group_key(cite: Column, body: Column) -> Column:
    c, b = normal_cite(cite), body_prefix(body)
    return F.when((c == "") & (b == ""), "").otherwise(F.concat(c, F.lit("||"), b))


def doi(given: Column, url: Column) -> Column:
    own = F.regexp_replace(F.lower(text(given)), "^https?://(dx\\.)?doi\\.org/", "")
    return F.when(text(given) != "", own).otherwise(F.lower(F.regexp_extract(text(url), "(?i)doi\\.org/(10\\.\\d+/[^\\s?#]+)", 1)))


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(text(url), "#", 1), "/$", "")


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^www\\.", "")


def command(c: Column) -> tuple[Column, Column]:
    """Name and rest of a line that begins with a slash command; nulls for others."""
    form = "(?s)^/([a-z]+)(?:\\s+(.*))?$"
    line = F.trim(text(c))
    return F.when(line.rlike(form), F.regexp_extract(line, form, 1)), F.when(line.rlike(form), F.trim(F.regexp_extract(line, form, 2)))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def normal_for_match(c: Column) -> Column:
    """Quotes, dashes and marks folded, lower case, single spaces."""
    out = text(c)
    for a, b in zip("‘’“”–—", "''\"\"--"):  # a search for bytes takes less than a table of characters
        out = F.replace(out, F.lit(a), F.lit(b))
    return squeeze(F.lower(F.regexp_replace(F.regexp_replace(out, "(?i)==|\\*\\*|</?u>", ""), "¶", " ")))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case letters-and-digits tokens of a query."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def keyword_score(query: str, value: Column) -> Column:
    """8 for each distinct token of the query that occurs, and 1 for each occurrence."""
    hay = squeeze(F.lower(text(value)))
    import re

    wanted = list(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", " ".join(query.lower().split())) if len(t) >= 3))
    total = F.lit(0).cast("bigint")
    for t in wanted:
        n = ((F.length(hay) - F.length(F.replace(hay, F.lit(t), F.lit("")))) / len(t)).cast("bigint")
        total = total + F.when(n > 0, n + 8).otherwise(0)
    return total


def any_keyword(query: str, value: Column) -> Column:
    import re

    hay = squeeze(F.lower(text(value)))
    wanted = list(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", query.lower()) if len(t) >= 3))
    if not wanted:
        return hay != ""
    out = F.lit(False)
    for t in wanted:
        out = out | hay.contains(t)
    return out
