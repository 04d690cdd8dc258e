"""Fidelity of excerpts, checks of cuts, boilerplate and span snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.sources.scratch import written

BOILERPLATE = r"(?i)^\s*(references|bibliography|works cited|acknowledg(e)?ments?|about the author|author(s)? (bio|biography|note)|disclosures?|conflicts of interest|funding|data availability|appendix|supplementary materials?)\b"
REFERENCE_LINE = r"^\[?\s*(\d+\.|\[\d+\])"
REFERENCE_WORDS = r"(?i)\b(doi|http|vol\.?\s*\d+|pp\.)\b"


def fidelity(pairs: DataFrame, width: int = 5, stride: int = 3, least: float = 0.98) -> DataFrame:
    """pairs (body, source) with n_windows, n_found, share, ok and the first five windows that the source lacks."""
    w = text.words(F.lower(text.text(F.col("body"))))
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.size(x) - (width - 1), F.lit(1)), F.lit(stride))
    grams = text.let(w, lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(x, i, F.lit(width)), " ")))
    out = pairs.withColumn("_g", grams).withColumn("_s", text.squeeze(F.lower(text.text(F.col("source")))))
    missing = F.filter("_g", lambda g: ~F.contains(F.col("_s"), g))
    out = out.withColumn("_m", missing).withColumn("n_windows", F.size("_g").cast("bigint")).withColumn("n_found", (F.size("_g") - F.size("_m")).cast("bigint"))
    share = F.coalesce(F.try_divide("n_found", "n_windows"), F.lit(0.0))
    return out.withColumns({"share": share, "ok": share >= least, "missing": F.slice("_m", 1, 5)}).drop("_g", "_s", "_m")


def validate_cut(cards: DataFrame, most_marked: float = 0.35, most_lined: float = 0.7, longest_run: int = 5) -> DataFrame:
    """id, n_paragraphs, issues: paragraphs marked too densely, runs of marked words that are too long, text that the source lacks."""
    p = cards.select("id", F.posexplode(F.split("body_markdown", "\n+")).alias("pos", "para"), text.normal_for_match(F.col("source")).alias("_s"))
    p = p.filter(F.trim("para") != "")
    n = F.greatest(text.n_words(text.strip_marks(F.col("para"))), F.lit(1))
    lit_spans = F.regexp_extract_all("para", F.lit("(?s)==(.+?)=="), F.lit(1))
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    marked = total(F.transform(lit_spans, lambda s: text.n_words(text.strip_marks(s))))
    lined = total(F.transform(F.regexp_extract_all("para", F.lit("(?s)<u>(.+?)</u>"), F.lit(1)), lambda s: text.n_words(text.strip_marks(s))))
    run = F.aggregate(lit_spans, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, text.n_words(text.strip_marks(s))))
    issue = lambda bad, name: F.when(bad, F.lit(name))
    issues = F.filter(F.array(issue(marked / n > most_marked, "marked too densely"), issue(lined / n > most_lined, "underlined too densely"), issue(run > longest_run, "long marked run"), issue(~F.contains(F.col("_s"), text.normal_for_match(F.col("para"))), "not in source")), lambda x: x.isNotNull())
    return p.withColumn("i", issues).groupBy("id").agg(F.count("*").alias("n_paragraphs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("issues"))


def strip_boilerplate(paras: DataFrame, heading: str = BOILERPLATE, key: str = "doc_id") -> DataFrame:
    """Paragraphs before the first heading of the back matter, without reference lines; all of them where nothing would be left."""
    t = F.trim("text")
    gone = F.max(t.rlike(text.js(heading))).over(Window.partitionBy(key).orderBy("pos"))
    reference = t.rlike(REFERENCE_LINE) & (F.length(t) < 500) & t.rlike(text.js(REFERENCE_WORDS))
    p = paras.withColumn("_kept", ~gone & ~reference)
    any_ = F.max("_kept").over(Window.partitionBy(key))
    return p.withColumn("_any", any_).filter("_kept or not _any").drop("_kept", "_any")


def strip_prelude(paras: DataFrame, form: str = r"(?i)^\s*abstract\b", key: str = "doc_id", least: int = 3) -> DataFrame:
    w = Window.partitionBy(key)
    p = paras.withColumn("_k", F.row_number().over(w.orderBy("pos"))).withColumn("_n", F.count("*").over(w))
    return p.filter(~((F.col("_k") == 1) & (F.col("_n") >= least) & F.col("text").rlike(text.js(form)))).drop("_k", "_n")


def snap_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, start, stop) widened to the words that they touch; dropped if they touch none."""
    t = F.col("text")
    size = lambda c, form: F.length(F.regexp_extract(c, form, 0))
    inner = F.substring(t, F.col("start") + 1, F.col("stop") - F.col("start"))
    lead, trail = size(inner, "(?U)^\\s*"), size(inner, "(?U)\\s*\\z")
    before, after = size(F.substring(t, F.lit(1), F.col("start")), "(?U)\\S*\\z"), size(F.substring(t, F.col("stop") + 1, F.length(t)), "(?U)^\\S*")
    j = spans.join(docs, key).filter(inner.rlike("(?U)\\S"))
    return j.select(key, F.when(lead > 0, F.col("start") + lead).otherwise(F.col("start") - before).alias("start"), F.when(trail > 0, F.col("stop") - trail).otherwise(F.col("stop") + after).alias("stop"))


#: The largest shares of words that may be highlighted and underlined, by density.
HIGHLIGHT_CAPS = {"minimal": 0.20, "standard": 0.25, "heavy": 0.30}
UNDERLINE_CAPS = {"minimal": 0.40, "standard": 0.55, "heavy": 0.72}
LONGEST_RUN = 5
UNDERLINED = "(?is)<u>(.*?)</u>"
HIGHLIGHTED, BOLD = "==([^=]+)==", "\\*\\*[^*]+\\*\\*"
#: The kinds of issue, in the order in which they are told.
ISSUES = ("highlighted too densely", "underlined too densely", "long highlight", "highlight outside underline", "bold outside underline", "not verbatim", "trimmed")


#: All white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _paragraphs(body: Column) -> Column:
    """Blocks between blank lines, without figures that were left out."""
    blocks = F.transform(F.split(text.text(body), "\\n(?U:\\s*)\\n+"), lambda p: F.btrim(p, F.lit(SPACES)))
    return F.filter(blocks, lambda p: (p != "") & (p != "[FIGURE OMITTED]"))


def cut_issues(cards: DataFrame, density: str = "heavy", key: str = "id") -> DataFrame:
    """(key, paragraph, issue, value): what is wrong with a cut (body_markdown) of a source; paragraphs count from 1.

    value: the share of words that is marked, or the words of the longest run. Marks outside an underline are looked for in
    what is left when underlined spans are taken out. A paragraph should be a whole paragraph of the source, in normal
    form: whole ones meet by equality, and only those without a partner are looked for inside the source, where they are
    trimmed or not verbatim. Cards without a source aren't compared with it; paragraphs without words, and null or
    empty bodies, have no issues; key names one card; an unknown density is heavy.
    """
    lit, low = HIGHLIGHT_CAPS.get(density, HIGHLIGHT_CAPS["heavy"]), UNDERLINE_CAPS.get(density, UNDERLINE_CAPS["heavy"])
    bare = lambda c: F.regexp_replace(F.replace(F.replace(c, F.lit("=="), F.lit("")), F.lit("**"), F.lit("")), "(?i)</?u>", "")
    n_words = lambda c: F.regexp_count(bare(c), F.lit("(?U)\\S+")).cast("bigint")
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + n_words(s))
    p = cards.select(key, F.posexplode(_paragraphs(F.col("body_markdown"))).alias("pos", "p")).withColumn("n", n_words(F.col("p"))).filter("n > 0")
    runs, lines = F.regexp_extract_all("p", F.lit(HIGHLIGHTED), F.lit(1)), F.regexp_extract_all("p", F.lit(UNDERLINED), F.lit(1))
    outside = F.array_join(F.filter(F.split("p", UNDERLINED), lambda s: s != ""), " ")
    digest = lambda c: F.when(c != "", F.unhex(F.md5(c.cast("binary"))))
    # each measure is taken once, and both halves below read it
    measured = written(p.select(
        key, (F.col("pos") + 1).alias("paragraph"), (total(runs) / F.col("n")).alias("lit"), (total(lines) / F.col("n")).alias("low"), F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, n_words(s))).alias("run"),
        outside.rlike(HIGHLIGHTED).alias("lit_out"), outside.rlike(BOLD).alias("bold_out"), digest(text.normal_for_match(F.col("p"))).alias("norm"),
    ), "measured")

    def issue(k: int, bad: Column, value: Column | None = None) -> Column:
        shown = F.round(value, 6) if value is not None else F.lit(None)
        return F.when(bad, F.struct(F.lit(ISSUES[k]).alias("issue"), shown.cast("double").alias("value")))

    marks = F.array(issue(0, F.col("lit") > lit, F.col("lit")), issue(1, F.col("low") > low, F.col("low")), issue(2, F.col("run") > LONGEST_RUN, F.col("run")), issue(3, F.col("lit_out")), issue(4, F.col("bold_out")))
    told = measured.select(key, "paragraph", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("x")).select(key, "paragraph", "x.issue", "x.value")

    given = cards.select(key, F.explode(_paragraphs(F.col("source"))).alias("p")).select(key, digest(text.normal_for_match(F.col("p"))).alias("norm")).distinct()
    given = written(given, "given").filter("norm is not null")
    sourced = given.select(key).distinct()
    open_ = measured.select(key, "paragraph", "norm").filter("norm is not null").join(sourced, key, "left_semi").join(given, [key, "norm"], "left_anti")
    # only cards with such paragraphs are read again, each with the places of them
    places = open_.groupBy(key).agg(F.collect_list("paragraph").alias("open"))
    held = cards.select(key, "body_markdown", "source").join(places, key)
    sources = F.filter(F.transform(_paragraphs(F.col("source")), text.normal_for_match), lambda x: x != "")
    paras = held.select(key, "open", F.array_join(sources, " § ").alias("all"), _paragraphs(F.col("body_markdown")).alias("paras"))
    each = paras.select(key, "all", "paras", F.explode("open").alias("paragraph")).select(key, "paragraph", F.contains("all", text.normal_for_match(F.element_at("paras", F.col("paragraph")))).alias("held"))
    against = each.select(key, "paragraph", F.when(F.col("held"), F.lit(ISSUES[6])).otherwise(F.lit(ISSUES[5])).alias("issue"), F.lit(None).cast("double").alias("value"))
    return told.unionByName(against)
