"""Personal data: strict patterns, and boosted trees over candidates from looser ones.

Base spans are the leftmost non-overlapping matches of one strict pattern for each kind that pass its check.
They always stay. Besides, high-recall generators propose spans that may overlap; trees score
them by their format and context. The trees learn from texts in which every base span is rewritten in place
into a form that the strict pattern misses (written-out signs, no plus or country code, spaces, dots), so what
they know of personal data doesn't depend on the strict pattern. Of all candidates in all documents, a rewritten
span is right; another kind or place there is wrong, as is a candidate elsewhere that its kind's check or looks
refute; a candidate elsewhere that might be personal data teaches nothing. Each kind has a threshold, the
smallest at which at least `precision` of the candidates of a held-back third are right. Selected candidates
that touch no base span are added; where they overlap, the likelier one stays.

Spans are found by column expressions within the document's row: no shuffle, join or Python; for training, candidates
that look alike are counted by one shuffle. Spark's learner looks for places to split at on at most 10,000 of the counted
rows by its own choice; all of them count in the trees and the thresholds. Patterns are written with possessive
quantifiers so that long runs take linear time and no stack.

Defined results: null and empty texts have no spans; offsets count code points; where the candidates don't
show both labels nothing is added; repeated rows are treated each for itself; columns of other names are left
alone; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import boosting
from lectern.llm.common import let, written

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns. A run of word characters that fails at its start fails everywhere in it, so matches start
#: at the run's start (or where the last match ended).
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser ones: written-out signs, missing country codes, spaces within, too few or many digits. Their bounds keep a
#: proposal to what such a thing can be: 64 characters before an at sign and 63 in a label, as standards of addresses
#: have it, up to six labels, 4 + 4 x 6 digits of a card, 26 characters of a number. They limit what is proposed, not what
#: is read: base spans have no such bounds, and every place of a text is looked at.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[{]at[)\]}])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20\.\x20?|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]{2,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9.])(?:\+\x20?)?[0-9(](?:[0-9()\x20/-]|\.(?!\x20)){7,24}[0-9](?![0-9])",
}
CONTEXT = r"(?i)(?:e-?mail|contact|write|tel|phone|call|mobile|fax|card|visa|pay|iban|account|host|server|address|ip)[^A-Za-z]{0,3}$"
SPAN = "struct<s:int,e:int,m:string,l:string,r:string>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, l, r): leftmost non-overlapping matches, with the characters before and after."""
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(x: Column) -> Column:
        each = F.transform(x["m"], lambda m, i: F.struct(F.get(x["p"], i).alias("before"), m.alias("m"), F.get(x["p"], i + 1).alias("after")))

        def step(acc: Column, v: Column) -> Column:
            s = acc["at"] + F.length(v["before"])
            e = s + F.length(v["m"])
            one = F.struct(s.alias("s"), e.alias("e"), v["m"].alias("m"), F.right(v["before"], F.lit(16)).alias("l"), F.left(v["after"], F.lit(4)).alias("r"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(each, start, step, lambda acc: acc["out"])

    return let(parts, placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    values = F.transform(F.split(F.reverse(digits), ""), doubled)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _may_hold(text: Column) -> Column:
    return text.rlike("[0-9@]|[(\\[{]at[)\\]}]")


def base_spans(text: Column, kind: str) -> Column:
    """Array of spans of one kind that its pattern matches and its check passes."""
    return F.filter(matches(text, STRICT[kind]), lambda x: _passes(kind, x["m"]))


FEATURES = ("kind", "length", "digits", "digit_share", "spaces", "hyphens", "dots", "plus", "brackets", "at", "groups", "longest_group", "after_word", "before_word", "context", "lead_zero", "checked")


def features(kind: int, x: Column) -> Column:
    """Numbers that describe the format of a candidate and what stands around it."""
    m = x["m"]
    count = lambda chars: (F.length(m) - F.length(F.translate(m, chars, ""))).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return F.array(
        F.lit(float(kind)), F.length(m).cast("double"), count("0123456789"), count("0123456789") / F.greatest(F.length(m), F.lit(1)), count(" "), count("-"), count("."), count("+"), count("()[]{}"), count("@"),
        F.size(groups).cast("double"), F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g))).cast("double"), flag(x["l"].rlike("[A-Za-z0-9]$")), flag(x["r"].rlike("^[A-Za-z0-9]")), flag(x["l"].rlike(CONTEXT)), flag(m.rlike("^[^0-9]?0")),
        flag(_checked(KINDS[kind], m)),
    )


def _checked(kind: str, m: Column) -> Column:
    """Whether a candidate passes its kind's check once loose signs and spaces are put back."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r"[(\[{]at[)\]}]", "@"), r"[(\[{]dot[)\]}]", "."), " ", "")
        return plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    return _passes(kind, F.replace(m, F.lit(" "), F.lit("")) if kind == "ip" else m)


def _open(kind: str, x: Column) -> Column:
    """Whether a candidate outside the rewritten spans might be personal data all the same."""
    m = x["m"]
    if kind != "phone":
        return _checked(kind, m)
    date = m.rlike(r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9])")
    looks = m.rlike(r"[+(]|[0-9][\x20./-]+[0-9]+[\x20./-]+[0-9]") | x["l"].rlike(CONTEXT)
    return F.length(_digits(m)).between(9, 15) & looks & ~date


def _loose_forms(kind: str, m: Column) -> list[Column]:
    """Ways to write a base span that its strict pattern misses."""
    if kind == "email":
        local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        signs = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" {at} ", " {dot} "), (" (at) ", "."), (" @ ", " . "), (" @ ", "."))
        return [F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in signs]
    if kind == "ip":
        return [F.replace(m, F.lit("."), F.lit(dot)) for dot in (" . ", " .", ". ")]
    if kind == "card":
        d = _digits(m)
        fours = F.when(F.length(d).isin(16, 19), F.regexp_replace(d, "(....)(?=.)", "$1.")).otherwise(F.regexp_replace(d, "^(....)(......)", "$1.$2."))
        return [fours, F.regexp_replace(fours, r"\.(?=[0-9]+$)", " "), F.regexp_replace(fours, r"^([0-9]+)\.([0-9]+)\.", "$1 $2.")]
    bare, national = F.substring(m, 2, 1 << 20), F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]+", "")
    return [bare, F.concat(F.lit("+ "), bare), F.regexp_replace(national, r"^\+", ""), F.concat(F.lit("0"), F.regexp_replace(national, r"^\+", "")), F.regexp_replace(F.regexp_replace(bare, "[()]", ""), r"[\x20-]", "."), F.regexp_replace(F.regexp_replace(national, r"[()+]", ""), r"[\x20.-]", "/")]


def disguised(text: Column) -> Column:
    """(text, places): each base span in one of its loose forms, chosen by a hash, and (s, k, e) of where they stand."""
    spans = F.sort_array(F.concat(*(F.transform(base_spans(text, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), x["m"].alias("m"))) for n, kind in enumerate(KINDS))))

    def form(x: Column) -> Column:
        out = x["m"]
        for n, kind in enumerate(KINDS):
            forms = F.array(*_loose_forms(kind, x["m"]))
            out = F.when(x["k"] == n, F.get(forms, F.pmod(F.xxhash64(x["m"], x["s"]), F.size(forms)).cast("int"))).otherwise(out)
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), out.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        s = acc["n"] + x["s"] - acc["at"]
        e = s + F.length(x["m"])
        place = F.struct(s.alias("s"), x["k"].alias("k"), e.alias("e"))
        more = F.struct(x["e"].alias("at"), e.alias("n"), F.concat(acc["out"], F.array(before, x["m"])).alias("out"), F.concat(acc["places"], F.array(place)).alias("places"))
        return F.when(x["s"] >= acc["at"], more).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), _none("string").alias("out"), _none("struct<s:int,k:int,e:int>").alias("places"))
    return F.aggregate(F.transform(spans, form), start, step, lambda acc: F.struct(F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))).alias("text"), acc["places"].alias("places")))


def _examples(text: Column) -> Column:
    """Array of (kind, s, f, label) of the candidates in a text's disguised form; label is null where nothing tells."""

    def of(d: Column) -> Column:
        def label(c: Column) -> Column:
            exact = F.exists(d["places"], lambda b: (b["k"] == c["kind"]) & (b["s"] == c["s"]) & (b["e"] == c["e"]))
            touched = F.exists(d["places"], lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
            return F.when(c["base"], F.lit(None)).when(exact, 1.0).when(touched | ~c["open"], 0.0)

        one = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["f"].alias("f"), label(c).cast("double").alias("label"))
        return F.transform(_candidates(d["text"], judged=True), one)

    return let(disguised(text), of)


def _candidates(text: Column, judged: bool = False) -> Column:
    """Array of (kind, s, e, f, base): all proposals, and whether a base span of their kind has the same place.

    judged: also `open`, see _open.
    """

    def proposed(n: int, kind: str) -> Column:
        place = lambda x: x["s"].cast("long") * F.lit(1 << 31) + x["e"]
        spans = F.array_distinct(F.concat(matches(text, STRICT[kind]), matches(text, LOOSE[kind])))
        one = lambda x, at: F.struct(F.lit(n).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), features(n, x).alias("f"), F.array_contains(at, place(x)).alias("base"), *([_open(kind, x).alias("open")] if judged else []))
        return let(F.transform(base_spans(text, kind), place), lambda at: F.transform(spans, lambda x: one(x, at)))

    return F.concat(*(proposed(n, kind) for n, kind in enumerate(KINDS)))


@dataclass
class Model:
    """held_back: by kind, how many candidates of the held-back third its threshold selects, how many of those are right, and how many right ones there are."""

    trees: boosting.Trees | None
    thresholds: dict[int, float]
    held_back: dict[int, tuple[int, int, int]] = field(default_factory=dict)


def train(docs: DataFrame, precision: float = 0.95) -> Model:
    """Trees and thresholds from all labelled candidates in the disguised texts of all documents.

    Candidates that look alike in every feature and have one label are one example with their number as its weight.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("_lectern_text")).filter(_may_hold(F.col("_lectern_text")))
    rows = rows.select("doc_id", F.explode(_examples(F.col("_lectern_text"))).alias("c")).select("doc_id", "c.kind", "c.f", "c.label").filter("label is not null")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    examples = written(rows.groupBy((part == 0).alias("held"), "kind", "f", "label").agg(F.count("*").alias("n")), "examples")
    trees = boosting.fit(examples.filter("not held"), weight="n")
    if trees is None:
        return Model(None, {})
    scored = examples.filter("held").select("kind", "label", "n", F.floor(trees.probability(F.col("f")) * 100).alias("p"))
    table = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("right")).collect()  # at most 4 x 101 rows
    thresholds, held_back = {}, {}
    for kind in range(len(KINDS)):
        mine = sorted(((r["p"], r["n"], r["right"]) for r in table if r["kind"] == kind), reverse=True)
        n = right = 0
        for p, k, good in mine:
            n, right = n + k, right + good
            if p >= 50 and right >= precision * n:
                thresholds[kind], held_back[kind] = p / 100, (n, int(right), int(sum(x for *_, x in mine)))
    return Model(trees, thresholds, held_back)


def find(docs: DataFrame, model: Model, named: tuple[str, str] = ("base", "pii")) -> DataFrame:
    """The rows of docs with base and pii: arrays of (s, k, e), k the kind's number, in order of s and k.

    named: what to call these two; columns of docs with the same names are replaced.
    """
    base_name, pii_name = named
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
    place = "struct<s:int,k:int,e:int>"
    held = lambda k, spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    base = F.sort_array(F.concat(*(held(n, base_spans(F.col("_lectern_text"), kind)) for n, kind in enumerate(KINDS))))
    out = docs.drop(*named).withColumn("_lectern_text", text).withColumn(base_name, F.when(_may_hold(F.col("_lectern_text")), base).otherwise(_none(place)))
    if model.trees is None or not model.thresholds:
        return out.withColumn(pii_name, F.col(base_name)).drop("_lectern_text")

    def chosen(c: Column) -> Column:
        least = F.lit(2.0)
        for kind, t in model.thresholds.items():
            least = F.when(c["kind"] == kind, F.lit(t)).otherwise(least)
        return ~c["base"] & (c["p"] >= least)

    # candidates that touch no base span, in order of place: of overlapping ones the likelier stays
    scored = F.transform(_candidates(F.col("_lectern_text")), lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"), model.trees.probability(c["f"]).alias("p"), c["base"].alias("base")))
    apart = lambda c: ~F.exists(F.col(base_name), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    good = F.sort_array(F.filter(F.filter(scored, chosen), apart))
    kind = "array<struct<s:int,kind:int,e:int,p:double,base:boolean>>"

    def step(acc: Column, c: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        clash = (F.size(acc) > 0) & (last["e"] > c["s"])
        return F.when(~F.coalesce(clash, F.lit(False)), F.concat(acc, F.array(c))).when(c["p"] > last["p"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(c))).otherwise(acc)

    added = F.transform(F.aggregate(good, F.array().cast(kind), step), lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("k"), c["e"].alias("e")))
    return out.withColumn(pii_name, F.when(_may_hold(F.col("_lectern_text")), F.sort_array(F.concat(F.col(base_name), added))).otherwise(F.col(base_name))).drop("_lectern_text")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; where spans overlap, their union by the first one's."""
    found = find(docs, model, ("_lectern_base", "_lectern_pii"))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        rest = F.greatest(acc["at"], x["e"])
        fresh = x["s"] >= acc["at"]
        kept = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(rest.alias("at"), F.when(fresh, F.concat(acc["out"], F.array(kept, F.get(names, x["k"])))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(F.col("_lectern_pii"), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("_lectern_pii") > 0, text).otherwise(F.col("text"))).drop("_lectern_base", "_lectern_pii")
