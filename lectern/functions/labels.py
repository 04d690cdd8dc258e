"""Labels derived from a card's stored fields, and keyword classification."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import capital, js, let, lookup, squeeze, text, title_case, title_case_topic

#: Fixed values.
TYPE_LABELS = {"policy": "Policy", "k": "K", "phil": "Phil", "theory": "Theory", "tricks": "Tricks", "none": ""}


def json_array(c: Column) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def type_label(types: Column) -> Column:
    return F.coalesce(lookup(TYPE_LABELS, F.lower(F.trim(text(F.get(types, 0))))), F.lit(""))


def topic_label(tags: Column, bucket: Column) -> Column:
    first, bucket = F.trim(text(F.get(tags, 0))), F.trim(text(bucket))
    return F.when(first != "", title_case_topic(first)).when(bucket != "", bucket).otherwise("General LD")


def source_label(kind: Column) -> Column:
    return F.when(kind == "personal", "My Cards").otherwise("Public Community Cards")


def scope(kind: Column) -> Column:
    return F.when(kind == "personal", "my").otherwise("public")


def resolution_label(division: Column, path: Column) -> Column:
    source = F.lower(F.concat_ws(" ", text(division), text(path)))

    def years(form: str, group: int) -> Column:
        yy = F.regexp_extract(source, form, group)
        return F.concat(F.lit("20"), yy, F.lit("-"), F.lpad((yy.try_cast("int") + 1).cast("string"), 2, "0"))

    named = F.when(F.regexp_extract(source, "(ndtceda|hspolicy)(\\d{2})", 1) == "ndtceda", "NDT/CEDA ").otherwise("HS Policy ")
    return (
        F.when(source.rlike("hsld\\d{2}"), F.concat(F.lit("HS LD "), years("hsld(\\d{2})", 1)))
        .when(source.rlike("(ndtceda|hspolicy)\\d{2}"), F.concat(named, years("(ndtceda|hspolicy)(\\d{2})", 2)))
        .otherwise(F.when(text(division) != "", title_case(division)).otherwise("General"))
    )


#: Fixed values: (all of these phrases in the text, bucket), the first that fits.
TOPIC_BUCKETS = (
    (("plea bargaining",), "Plea Bargaining"), (("artificial intelligence", "criminal justice"), "AI in Criminal Justice"), (("rewild",), "Rewilding"), (("green growth",), "Green Growth vs Degrowth"), (("degrowth",), "Green Growth vs Degrowth"),
    (("nuclear weapon",), "Nuclear Weapons"), (("geoengineering",), "Geoengineering"), (("economic sanctions",), "Economic Sanctions"), (("non-intervention",), "Non-Intervention"), (("civil liberties", "national security"), "Civil Liberties vs National Security"), (("development assistance",), "Development Assistance"),
)
#: Type and pattern over the lower-case text.
TYPE_RULES = (
    ("kritik", r"ontology|capitalism|settler colonialism|psychoanalysis|heidegger|nietzsche|lacan|biopower|foucault|critique|\bcap k\b"),
    ("da", r"disadvantage|\bbrink\b|uniqueness|link turn|impact turn|politics da"),
    ("counterplan", r"\bcp\b|counterplan|net benefit|\bcompetition\b|perm bad"),
    ("theory", r"topicality|\bshells?\b|\bviolation\b|\binterpretation\b|\bstandards\b|\bvoters\b|\bfairness\b|\beducation\b|\bcondo\b|\bpics\b|\bdispo\b"),
    ("tricks", r"\bskep\b|skepticism|a priori|\bpermissibility\b|\bpresumption\b|\bburden\b|\bspikes\b|framing trick"),
    ("phil", r"\bframework\b|\bvalue\b|\bcriterion\b|utilitarianism|deontology|\bkant\b|\bmill\b|\brawls\b|contractualism|consequentialism"),
    ("policy", r"\bplan\b|\binherency\b|\bharms\b|\badvantage\b|\bsolvency\b"),
)


def topic_bucket(c: Column) -> Column:
    low = F.lower(text(c))
    out = F.lit("General LD")
    for phrases, bucket in reversed(TOPIC_BUCKETS):
        all_in = F.lit(True)
        for p in phrases:
            all_in = all_in & low.contains(p)
        out = F.when(all_in, bucket).otherwise(out)
    return out


def boundaries_last(pattern: str) -> str:
    """js(pattern), with the boundary before a run of small letters asked for after the run, where few places get to.

    The same places match: a run that begins with a letter has a boundary before it if no word character stands there.
    """
    w = "[A-Za-z0-9_]"
    out = re.sub(r"\\b([a-z](?:[a-z ]*[a-z])?)(?![?*+{])", lambda m: f"{m[1]}(?<!{w}{m[1]})", pattern)
    out = re.sub(r"(?<!\\)(?:(?<=[a-z][a-z])|(?<=[a-z][a-z]\?))\\b", f"(?!{w})", out)
    return js(out)


def matching(rules, c: Column) -> Column:
    """Labels of the rules (label, pattern) that the text fits, in the rules' order."""
    return let(c, lambda s: F.filter(F.array(*(F.when(s.rlike(boundaries_last(p)), F.lit(label)) for label, p in rules)), lambda x: x.isNotNull()))


def argument_types(c: Column, rules=TYPE_RULES) -> Column:
    return let(matching(rules, F.lower(text(c))), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none"))))


def card_type(label: Column) -> Column:
    t = F.lower(text(label))
    return (
        F.when((t == "k") | t.contains("kritik"), "k").when(t.contains("policy"), "policy").when(t.contains("phil"), "phil").when(t.contains("tricks") | (t == "trick"), "tricks")
        .when(t.contains("theory") | (t == "t") | t.contains("topicality"), "theory").otherwise("")
    )


def is_general(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(text(p) for p in parts))).rlike("general\\s*ld")


def tag_score(tag: Column) -> Column:
    """Short, plain tags score high."""
    t = F.trim(text(tag))
    n = F.size(F.split(t, "(?U)\\s+"))
    out = F.lit(100.0) - F.length(t) * 0.6
    for hit, points in (
        (t.rlike(js("(?i)\\b(that|because|when|since|although|however|therefore|thus|moreover|the fact that)\\b")), -20), (F.size(F.split(t, "[.,;:]", -1)) > 2, -12), (t.rlike("\\.{3}|…"), -10), (n > 12, -10), (n < 2, -5),
        (t.rlike("(?i)^(the|a|an)\\s"), -3), (t.rlike("[!?.]$"), 2),
    ):
        out = out + F.when(hit, float(points)).otherwise(0.0)
    return F.when(t == "", -1000.0).otherwise(out)


#: Remarks on the opponent.
META = (
    r"(?i)\btheir\s+\w[\w\s]*?\s+is\s+(wrong|bad|false|incorrect|flawed|misleading|outdated)\b", r"(?i)\bthey\s+(misunderstood|misread|miscut|misuse|misconstrue|misrepresent|mis\w+)\b",
    r"(?i)\btheir\s+(author|ev(idence)?|card|cite|source|tag)\s+(says|is|doesn'?t|cuts?)\b", r"(?i)\bopponent'?s?\s+\w[\w\s]*?\s+(fails?|is wrong|misses?)\b", r"(?i)\b(no|non-?)\s*unique(ness)?\b",
)
#: What is tidied after that, in order.
TIDY = (
    (r"[ \t]{2,}", " "), (r"^\s+|\s+$", ""), (r"\s+([.,;:!?])", "$1"), (r"\s+--\s+", " — "), (r"^[\s\-—,;:]+|[\s\-—,;:]+$", ""), (r"^\s*\d+\s*[.\])\-—:]+\s*", ""), (r"(?i)^\s*T\s*[:\-—]+\s*", ""),
    (r"^\s*[A-Za-z]\s*[.\])\-—:]\s+", ""), (r"^\s*[*+]+\s*", ""), (r"\s+---\s*", "---"), (r"\s+—", "—"), (r"[ \t]{2,}", " "), (r"^\s+", ""),
)


#: How many of TIDY's last steps come after words that were split have been put together.
LAST = 2


def trimmed_tag(tag: Column) -> Column:
    """A tag without remarks, numbering and bullets, before words that were split are put together."""
    out = text(tag)
    for pattern in META:
        out = F.regexp_replace(out, js(pattern), "")
    for pattern, to in TIDY[:-LAST]:
        out = F.regexp_replace(out, pattern, to)
    return out


def finished_tag(tag: Column, trimmed: Column) -> Column:
    """The trimmed tag without stray spaces, with a capital; the tag itself if nothing is left."""
    out = trimmed
    for pattern, to in TIDY[-LAST:]:
        out = F.regexp_replace(out, pattern, to)
    out = capital(out)
    return F.when(text(tag) == "", tag).when(out == "", tag).otherwise(out)


def normal_tag(tag: Column) -> Column:
    """A card's tag without remarks, numbering, bullets and stray spaces, with a capital; the tag itself if nothing is left.

    Words that were split stay so; `operators.tags` puts them together by a table of words.
    """
    return finished_tag(tag, trimmed_tag(tag))


def classify_text(*parts: Column) -> Column:
    return squeeze(F.concat_ws(" ", *(text(p) for p in parts)))
