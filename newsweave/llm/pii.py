"""Personal data by contextual bootstrapping (operator 11), all in DataFrame functions.

Seeds are the matches of four fixed detectors: email, ip, card (Luhn) and phone.  A looser detector
finds what else might be one of them: numbers of 7 to 19 digits, IPv6 forms, written-out or
incomplete addresses.  A pattern is the two words before an occurrence, or the word before with the
word after.  Patterns and distinct values form a graph.  In each round a pattern is worth, for each
kind, the lower bound (Wilson, one-sided 95%) of the share of its values that are known to be of that
kind, values of other kinds and unknown ones counting against it; an unknown value is worth the
noisy-or of its trusted patterns and counts as known, by that weight, in the next round.  Values
that reach ``accept`` are personal data wherever they stand.  With the bound at 0.8 a pattern needs
eleven distinct values at least, so others are left out before the rounds without changing any.

Texts are read once, in map tasks, and give only short candidates with their contexts; these move by
row for their places and by pattern and value for the graph.  Matches are found by split() and
regexp_extract_all(), whose pieces give the places in code points by a running sum.  The detectors
are written without backtracking, so very long runs of one character take linear time.

Null texts are empty and have no spans.  Null and repeated ids keep one result a row; repeated rows
are equal values, so they weigh once in the graph.  Other columns are left out, so clashing names
don't matter.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, text_col

KINDS = ("email", "ip", "card", "phone")
#: Bound of a pattern's share, confidence of a value, normal deviate of the bound, rounds.
TRUST, ACCEPT, DEVIATE, ROUNDS = 0.8, 0.8, 1.645, 3
#: Characters before and after an occurrence that may give context words.
CONTEXT = 48

_LOCAL = "[A-Za-z0-9._%+-]"
#: A match begins where a run of such characters does, or behind the last match.
_AT_RUN = rf"(?:\G|(?<!{_LOCAL}))"
#: The detectors of the contract.  A card is a whole chain of digits, each parted by one blank or
#: hyphen at most; chains of other lengths would fail and are passed over at once.
BASE = {
    "email": rf"{_AT_RUN}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_APART = r"[\x20().:/-]"
#: What might be personal data in an unusual form.
LOOSE = "|".join([
    rf"(?<![0-9A-Za-z_])(?<![0-9]{_APART}{{1,3}})[+(]?[0-9](?:{_APART}{{0,3}}[0-9]){{6,18}}+(?!{_APART}{{0,3}}[0-9])(?![0-9A-Za-z_])",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    rf"{_AT_RUN}{_LOCAL}++(?:@|\x20?[\[({{]\x20?at\x20?[\])}}]\x20?)[A-Za-z0-9.-]++",
])
#: Texts without any of these are not searched.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "loose": r"[0-9:@]|[\[({]\x20?at\x20?[\])}]"}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def holds(kind: Column, value: Column) -> Column:
    """Whether a match of a detector passes its check."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind == "card", F.call_function("luhn_check", _digits(value)))
        .when(kind == "phone", n.between(9, 15)).otherwise(True)
    )


def loose_kinds(value: Column) -> Column:
    """Kinds that a loose match could be."""
    n, colons = F.length(_digits(value)), F.length(F.regexp_replace(value, "[^:]", ""))
    number = ~value.rlike("[A-Za-z@]|:.*:")
    kinds = F.array(
        F.when(value.rlike(r"[A-Za-z0-9]\x20?(?:@|[\[({]\x20?at\x20?[\])}])"), "email"),
        F.when(value.rlike("^[0-9A-Fa-f:]+$") & ((colons >= 3) | F.contains(value, F.lit("::"))), "ip"),
        F.when(number & n.between(12, 19), "card"), F.when(number & n.between(7, 15), "phone"),
    )
    return F.array_compact(kinds)


def _occurrence(form: str) -> Callable[[Column, Column], Column]:
    return lambda z, k: F.struct(
        F.lit(form).alias("form"), k.alias("k"), z["before"]["n"].alias("gap"), z["value"].alias("value"),
        z["before"]["left"].alias("left"), z["after"]["right"].alias("right"),
    )


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def occurrences(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(rid, id, found) for each row, found being an array of (form, k, gap, value, left, right): the
    k-th match of a detector, the length of the text between it and the one before, and what
    stands next to it."""
    forms = {**BASE, "loose": LOOSE}
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_col(text).alias("text"))
    none = F.array().cast("array<string>")
    for form, pattern in forms.items():
        hinted = F.col("text").rlike(HINTS[form])
        matches = F.when(hinted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        base = base.withColumn(f"{form}_matches", matches)
    for form, pattern in forms.items():
        gaps = F.when(F.size(f"{form}_matches") > 0, F.split("text", pattern, -1)).otherwise(none)
        short = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("left"), F.left(g, F.lit(CONTEXT)).alias("right")))
        base = base.withColumn(f"{form}_gaps", short)
    found = []
    for form in forms:
        matches, gaps = F.col(f"{form}_matches"), F.col(f"{form}_gaps")
        rest = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
        zipped = F.arrays_zip(matches.alias("value"), gaps.alias("before"), rest.alias("after"))
        found.append(F.transform(F.filter(zipped, lambda z: z["value"].isNotNull()), _occurrence(form)))
    return base.select("rid", "id", F.concat(*found).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """(rid, kind, start, end, value, left, right): checked matches of the detectors, and loose ones
    (kind null) that touch none of them."""
    rows = found.select("rid", F.inline("found")).repartition("rid")
    upto = Window.partitionBy("rid", "form").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("value")
    end = F.sum(F.col("gap") + length).over(upto)
    spans = (
        rows.withColumn("end", end).withColumn("start", F.col("end") - length)
        .where(holds(F.col("form"), F.col("value"))).withColumn("kind", F.when(F.col("form") != "loose", F.col("form")))
    )
    # both frames grow row by row; one that reached to the end would be summed anew for each row
    upward, downward = (Window.partitionBy("rid").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow) for c in ("start", F.col("start").desc()))
    base_end = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(upward)
    base_start = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(downward)
    free = F.coalesce(base_end <= F.col("start"), F.lit(True)) & F.coalesce(base_start >= F.col("end"), F.lit(True))
    return spans.withColumn("free", free).where("kind is not null or free").select("rid", "kind", "start", "end", "value", "left", "right")


def _words(side: str) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(side), r"[^\p{L}:=#]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def patterns() -> Column:
    """Lexical patterns of an occurrence: two words before; one before and one after."""
    before, after = _words("left"), F.get(_words("right"), F.lit(0))
    last = F.try_element_at(before, F.lit(-1))
    both = F.concat(F.lit("L "), F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("^")), F.lit(" "), last)
    around = F.concat(F.lit("B "), last, F.lit(" _ "), after)
    lexical = lambda p: F.when(F.regexp_replace(p, "^[LB] ", "").rlike(r"\p{L}"), p)
    return F.array_compact(F.array(lexical(both), lexical(around)))


def lower_bound(known: Column, n: Column) -> Column:
    """Of the share known / n, at ``DEVIATE`` standard deviations (Wilson)."""
    z2 = DEVIATE**2
    p = known / n
    spread = DEVIATE * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.round((p + z2 / (2 * n) - spread) / (1 + z2 / n), 9)


def discover(spans: DataFrame, trust: float = TRUST, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, confidence) of loose values that trusted patterns hold for personal data; one
    kind each.  ``spans`` is as placed() gives it."""
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(loose_kinds(F.col("value")))
    seen = spans.select(F.explode(patterns()).alias("pattern"), F.lower("value").alias("value"), kinds.alias("kinds"), F.col("kind").isNotNull().alias("seed")).distinct()
    least = trust * DEVIATE**2 / (1 - trust)  # with fewer values no share has such a lower bound
    # loose values of no kind count against a pattern as well
    sizes = seen.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    edges = checkpoint(seen.join(sizes, "pattern").select("pattern", "value", "n", F.explode("kinds").alias("kind"), "seed").distinct())
    known = edges.where("seed").select("pattern", "value", "kind", "n").distinct().withColumn("weight", F.lit(1.0))
    unknown = edges.where("not seed").join(edges.where("seed").select("value").distinct(), "value", "left_anti").select("pattern", "value", "kind", "n")
    seeds = checkpoint(known.groupBy("pattern", "kind", "n").agg(F.sum("weight").alias("known")))
    worth = None
    for _ in range(rounds):
        totals = seeds
        if worth is not None:
            later = unknown.join(worth, ["value", "kind"]).groupBy("pattern", "kind", "n").agg(F.sum("confidence").alias("known"))
            totals = seeds.unionByName(later).groupBy("pattern", "kind", "n").agg(F.sum("known").alias("known"))
        trusted = totals.select("pattern", "kind", lower_bound(F.least(F.col("known"), F.col("n")), F.col("n")).alias("bound")).where(F.col("bound") >= trust)
        missed = F.sum(F.log1p(-F.least("bound", F.lit(1 - 1e-9))))
        worth = checkpoint(
            unknown.join(trusted, ["pattern", "kind"]).groupBy("value", "kind").agg(F.round(1 - F.exp(missed), 6).alias("confidence"))
            .where(F.col("confidence") >= accept)
        )
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return worth.groupBy("value").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -order)).alias("best")).select("value", "best.*")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): (rid, id) for each row of ``docs``, and (rid, kind, start, end, value, confidence) of each
    span, places in code points; confidence is null for matches of the detectors."""
    found = checkpoint(occurrences(docs, id_col, text))
    spans = checkpoint(placed(found))
    base = spans.where("kind is not null").select("rid", "kind", "start", "end", "value", F.lit(None).cast("double").alias("confidence"))
    new = discover(spans).withColumnRenamed("value", "known")
    added = (
        spans.where("kind is null").drop("kind").join(new, F.lower("value") == F.col("known"))
        .select("rid", "kind", "start", "end", "value", "confidence")
    )
    return found.select("rid", "id"), base.unionByName(added)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``."""
    rows, spans = find(docs, id_col, text)
    order = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    own = spans.select("rid", F.struct(order.alias("at"), "start", "end", "kind", F.col("confidence").isNull().alias("base")).alias("span"))
    all_rows = rows.select("rid", F.struct("id").alias("doc")).withColumn("span", F.lit(None).cast(own.schema["span"].dataType))
    both = own.withColumn("doc", F.lit(None).cast(all_rows.schema["doc"].dataType)).select("rid", "doc", "span").unionByName(all_rows)
    joined = both.groupBy("rid").agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_sort(F.collect_list("span")).alias("spans"))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, k) for k in KINDS]
    return joined.select(
        F.col("doc.id").alias(id_col), *counts, F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
