"""Personal data in texts, in DataFrame and SQL functions only.

Fixed formats give base spans. Beside them, high-recall generators propose spans that may overlap: obfuscated
addresses, local telephone numbers, long numbers, and long opaque strings. Boosted trees score every candidate by its
format and its context. They learn from weak labels of a sample that is bounded for each kind and label (a base format that passes
its check, and for each added kind a cue or check of its own), and a threshold for each kind is calibrated on all candidates that
were not learned from. Of candidates that overlap, the likeliest stays; base spans always stay, and what overlaps them goes.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import hash_bound, stash

#: The base formats. Possessive repeats and the look-behinds only save time: they match the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "masked_email": r"[A-Za-z0-9._%+-]{1,64}[\x20]?[(\[]at[)\]][\x20]?[A-Za-z0-9-]{1,64}(?:[\x20]?[(\[]dot[)\]][\x20]?|\.)[A-Za-z]{2,24}",
    "local_phone": r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
    "number": r"[0-9](?:[\x20-]?[0-9]){6,}+",
    "opaque": r"[A-Za-z0-9_+/=-]{20,}+",
}
#: Texts without this hold no match of the kind.
GUARD = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "masked_email": r"[(\[]at[)\]]",
    "local_phone": r"[0-9]{2}\)?[\x20.-][0-9]{3}",
    "number": r"[0-9](?:[\x20-]?[0-9]){6}",
    "opaque": r"[A-Za-z0-9_+/=-]{20}",
}
KINDS = [*BASE, *MORE]
CONTEXT = 32
#: About so many candidates are learned from at most; each kind and label has an equal share.
SAMPLE_BOUND = 20_000
PRECISION = 0.95
#: What tells a kind's weak labels is hidden from the trees in half of the rows of that kind that they learn from, so that
#: they learn what else goes with it: a string of the format of secrets is likely one without the word before it, too.
HIDDEN = {
    "opaque": ("cue_secret", "cue_assigned"),
    "masked_email": ("cue_mail", "dots"),
    "local_phone": ("cue_phone",),
    "number": ("luhn", "cue_card", "cue_account"),
    "card": ("luhn",),
}
CUES = {
    "cue_mail": r"(?i)(?:e-?mail|contact|write)\W*\w*\W*$",
    "cue_phone": r"(?i)(?:tel|phone|call|fax|mobile)\W*\w*\W*$",
    "cue_card": r"(?i)(?:card|visa|account|iban|number)\W*\w*\W*$",
    "cue_account": r"(?i)(?:card|visa|account|iban)\W*\w*\W*$",
    "cue_secret": r"(?i)(?:token|key|secret|passw\w*|auth)\W*$",
    "cue_assigned": r"[=:][\x20]?[\"']?$",
}


def candidates(docs: DataFrame) -> DataFrame:
    """One row per match: doc_id, key (hash of the text), kind, start and end in code points, value, left and right of it."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    kinds = []
    for kind in KINDS:
        pattern = (BASE | MORE)[kind]
        values = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
        gaps = F.split("text", pattern, -1)
        found = F.struct(F.lit(kind).alias("kind"), values.alias("values"), gaps.alias("gaps"))
        kinds.append(F.when(F.col("text").rlike(GUARD[kind]), found))
    found = rows.where(" or ".join(f"text rlike r'{GUARD[k]}'" for k in KINDS)).select("doc_id", "key", F.explode(F.array_compact(F.array(*kinds))).alias("m"))
    found = found.select("doc_id", "key", "m.kind", "m.values", "m.gaps").where("size(values) > 0")
    spots = F.transform(
        "values",
        lambda v, i: F.struct(
            i.alias("i"),
            v.alias("value"),
            F.length(F.get("gaps", i)).alias("gap"),
            F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("left"),
            F.substring(F.get("gaps", i + 1), 1, CONTEXT).alias("right"),
        ),
    )
    found = found.select("doc_id", "key", "kind", F.inline(spots)).distinct()
    before = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return found.select("doc_id", "key", "kind", "start", "end", "value", "left", "right")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def checked(found: DataFrame) -> DataFrame:
    """found with digits and valid: whether a base match passes its kind's check; false for other kinds."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    small = F.forall(F.split("value", r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    n = F.length("digits")
    valid = (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", F.when((n >= 16) & (n <= 19), passes_luhn(F.col("digits"))).otherwise(False))
        .when(F.col("kind") == "phone", (n >= 8) & (n <= 15))
        .otherwise(False)
    )
    return found.withColumn("digits", digits).withColumn("valid", valid)


def features(found: DataFrame, veiled: Column | None = None) -> tuple[DataFrame, list[str]]:
    """found with numbers that describe a candidate's format and context, and their names; veiled: where HIDDEN applies."""
    size = F.length("value").cast("double")
    share = lambda p: F.length(F.regexp_replace("value", f"[^{p}]", "")) / size
    made = {
        "size": F.least(size, F.lit(64.0)),
        "n_digits": F.least(F.length("digits"), F.lit(32)).cast("double"),
        "digits_share": share("0-9"),
        "upper_share": share("A-Z"),
        "lower_share": share("a-z"),
        "hex_share": share("0-9a-f"),
        "vowel_share": share("aeiouAEIOU"),
        "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / size,
        "separator_share": share(r"\x20().-"),
        "dots": F.least(F.length(F.regexp_replace("value", r"[^.]", "")), F.lit(8)).cast("double"),
        "groups": F.least(F.size(F.split("value", r"[\x20().-]+")), F.lit(8)).cast("double"),
        "at_sign": F.col("value").contains("@").cast("double"),
        "plus": F.col("value").startswith("+").cast("double"),
        "luhn": F.when(F.length("digits").between(12, 19), passes_luhn(F.col("digits"))).otherwise(False).cast("double"),
        "left_word": F.col("left").rlike("[A-Za-z0-9]$").cast("double"),
        "right_word": F.col("right").rlike("^[A-Za-z0-9]").cast("double"),
        "quoted": (F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")).cast("double"),
        # one string may be a candidate of several kinds, with labels of their own
        **{f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS},
        **{name: F.col("left").rlike(cue).cast("double") for name, cue in CUES.items()},
    }
    if veiled is not None:
        hidden = {c: [k for k, own in HIDDEN.items() if c in own] for c in made}
        made |= {c: F.when(veiled & F.col("kind").isin(kinds), 0.0).otherwise(made[c]) for c, kinds in hidden.items() if kinds}
    return found.withColumns(made), list(made)


def weak_label(kind: str = "kind") -> Column:
    """1 where a base check passes, or where an added kind has a sign of its own.

    An opaque string is assigned to a name of a secret, an obfuscated address hides its dot too or follows a mail cue, a local
    telephone number follows a telephone cue, and a long number passes Luhn's check or follows a card or account cue.
    """
    secret = (F.col(kind) == "opaque") & F.col("left").rlike(r"(?i)(?:token|key|secret|passw\w*|auth)[\x20]?[=:][\x20]?[\"']?$")
    masked = (F.col(kind) == "masked_email") & (F.col("left").rlike(CUES["cue_mail"]) | F.col("value").rlike(r"[(\[]dot[)\]]"))
    local = (F.col(kind) == "local_phone") & F.col("left").rlike(CUES["cue_phone"])
    luhn = F.when(F.length("digits").between(12, 19), passes_luhn(F.col("digits"))).otherwise(False)
    number = (F.col(kind) == "number") & (F.col("left").rlike(CUES["cue_account"]) | luhn)
    return (F.col("valid") | secret | masked | local | number).cast("double")


def likely(found: DataFrame, bound: int = SAMPLE_BOUND) -> DataFrame:
    """(doc_id, key, kind, start, end, p): the candidates of the added kinds that the boosted trees select, p their probability.

    None where what is learned from is of one class only, or where no threshold of a kind is precise enough.
    """
    place = ["doc_id", "key", "kind", "start", "end"]
    spot = F.pmod(F.xxhash64(F.lit(3), "doc_id", "key", "kind", "start"), F.lit(1_000_000))
    every = found.select("kind", weak_label().alias("label")).groupBy("kind", "label").count().collect()  # at most two rows a kind
    limits = [
        F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), math.ceil(hash_bound(r["count"], bound // (2 * len(KINDS))) * 1_000_000))
        for r in every
    ]
    dealt = found.withColumns({"label": weak_label(), "fold": F.pmod(F.xxhash64("value", "left"), F.lit(3)), "drawn": spot < F.coalesce(*limits, F.lit(0))})
    half = F.pmod(F.xxhash64(F.lit(4), "doc_id", "key", "kind", "start"), F.lit(2)) == 0
    sample, names = features(dealt.where("drawn and fold <> 0"), half)
    sample = stash(sample.select("label", *names))
    described, _ = features(dealt.where(F.col("kind").isin(*MORE)))
    classes = sample.select("label").distinct().count()
    none = found.select(*place).limit(0).withColumn("p", F.lit(0.0))
    if classes < 2:
        return none
    pack = VectorAssembler(inputCols=names, outputCol="__x")
    trees = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=1)
    model = trees.fit(pack.transform(sample))
    scored = model.transform(pack.transform(described))
    fitted = (F.col("drawn") & (F.col("fold") != 0)).alias("fitted")
    scored = stash(scored.select(*place, "label", fitted, vector_to_array("probability")[1].alias("p")))
    held = scored.where("not fitted").withColumn("bin", F.floor(F.col("p") * 20) / 20)
    bins = held.groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("all")).collect()
    least = {}
    for kind in MORE:
        good = every = 0.0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            good, every = good + r["good"], every + r["all"]
            if r["bin"] >= 0.5 and good >= PRECISION * every:
                least[kind] = r["bin"]
    if not least:
        return none
    enough = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("p") >= v), True) for k, v in least.items()), F.lit(False))
    return scored.where(enough).select(*place, "p")


def selected(docs: DataFrame, bound: int = SAMPLE_BOUND) -> DataFrame:
    """(doc_id, key, kind, start, end, base): base spans that pass their checks, and added ones without overlap."""
    found = stash(checked(candidates(docs)))
    base = found.where("valid").select("doc_id", "key", "kind", "start", "end", F.lit(True).alias("base"), F.lit(2.0).alias("p"))
    more = likely(found, bound).select("doc_id", "key", "kind", "start", "end", F.lit(False).alias("base"), "p")
    every = base.union(more)
    text = Window.partitionBy("doc_id", "key")
    order = text.orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("__first", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    every = every.withColumn("__run", F.sum("__first").over(order))
    run = Window.partitionBy("doc_id", "key", "__run").orderBy(F.desc("p"), "start", F.desc("end"), "kind")
    every = every.withColumn("__place", F.row_number().over(run))
    return every.where("base or __place = 1").select("doc_id", "key", "kind", "start", "end", "base")


def find_spans(docs: DataFrame, bound: int = SAMPLE_BOUND) -> DataFrame:
    """(doc_id, n_<base kind>..., base_spans, spans) for each row of docs.

    Spans are written kind:start:end, by kind in the order of KINDS and then by start, joined by commas; offsets are in
    code points, the end exclusive. Null and empty texts have none. Rows that repeat a doc_id and text are
    searched once and all get the result; a null doc_id is a value like others. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    spans = selected(rows, bound)
    rank = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)))
    written = F.concat_ws(":", "kind", "start", "end")
    item = F.struct(rank.alias("r"), "start", "end", written.alias("w"), "base")
    found = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = rows.select("doc_id", F.xxhash64("text").alias("key")).alias("d").join(
        stash(found).alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key")), "left"
    )
    own = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    joined = joined.select("d.doc_id", own.alias("items"), F.filter(own, lambda x: x["base"]).alias("base"))
    ranks = F.transform("base", lambda x: x["r"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return joined.select("doc_id", *counts, F.array_join("base.w", ",").alias("base_spans"), F.array_join("items.w", ",").alias("spans"))
