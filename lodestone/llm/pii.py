"""Personal data by candidate gradient boosting, on DataFrame functions alone.

Generators with high recall propose spans that may overlap: the four base kinds and looser ones (numbers
with an area code, government numbers, bank and hardware addresses, spelled-out mail addresses). Base
spans that hold are reported always. The others are judged by boosted trees on their format and context.

The trees learn what each candidate's own structure says of it, which is not among their features: base
matches hold or fail, a bank number's checksum, a government or area number's ranges, a hardware address's
bits, a mail address's ending do or don't; plain numbers are negative. By chance alone, a share of random
candidates pass a generator's test (CHANCE). A fold of the documents that the trees haven't seen gives each
generator a threshold of its own: the lowest probability above which its candidates are genuine with
PRECISION, the share that chance lets pass taken off. Where chance lets few pass, what fails is certainly not
genuine, and only what passes counts and is added; the other tests say something of many candidates, but
little of one. A generator with fewer than LEAST candidates in that fold takes the threshold of the base
kinds. A candidate whose probability reaches the threshold is added, unless it overlaps a base span or a
better candidate.

Defined results: a null text counts as empty and gives zero counts, the hash of the empty string and empty
spans; rows are keyed by doc_id and text, so rows that share both get the same result each, and null
doc_ids do no harm; without matches that fail there is nothing to learn from and nothing is added; other
columns are ignored. Offsets are code points. Runs of any length are matched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import boosting
from lodestone.llm.common import stage

BASE_KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and the starts of runs change no match, only the time that long
# runs without a match take: a mail address begins at the start of its run or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # wider nets, judged by the trees
    "local": r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "government": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "bank": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hardware": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,}+\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,}+",
    "number": r"(?<![0-9])(?=[0-9][0-9.,:/-]{4,}[0-9])[0-9]++(?:[.,:/-]++[0-9]++)*+",
}
#: The share of random candidates that pass a generator's own test: 1 in 97 checksums; 899 of 1,000 area
#: numbers, 99 of 100 groups and 9,999 of 10,000 serials; 8 of 10 first digits twice, 9 of 10 second ones, 99
#: of 100 exchanges; half of the addresses; about that of endings.
CHANCE = {"bank": 1 / 97, "government": 0.898 * 0.99 * 0.9999, "local": 0.8 * 0.9 * 0.8 * 0.99, "hardware": 0.5, "spelled": 0.05}
CONTEXT, FEATURE_NAMES = 24, ["digits", "letters", "breaks", "size", "plus", "at", "cue", "against", "before_kind", "after_kind", "distinct"]
PRECISION, FOLDS, LEAST = 0.95, 5, 30


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash of every row, and found: for each kind its matches in order, as the length of the gap
    before, the match, the CONTEXT characters before it and the one after it. One pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), text.alias("t"))
    own = own.withColumn("digit", F.col("t").rlike("[0-9]"))
    gates = {
        "email": F.col("t").contains("@"),
        "card": F.col("digit") & F.col("t").rlike(r"[0-9](?:[\x20-]?[0-9]){13,}+"),
        "phone": F.col("digit") & F.col("t").contains("+"),
        "spelled": F.col("t").rlike(r"[\[(]dot[\])]"),
    }
    gate = {k: gates.get(k, F.col("digit")) & F.col("t").rlike(p) for k, p in PATTERNS.items()}
    cut = own.select("doc_id", "text_hash", *[F.when(gate[k], F.struct(F.split("t", p, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("hits"))).alias(k) for k, p in PATTERNS.items()])

    def matches(kind: str) -> Column:
        at = F.sequence(F.lit(0), F.size(F.col(kind)["hits"]) - 1)
        gap = lambda i: F.get(F.col(kind)["gaps"], i)
        each = F.transform(at, lambda i: F.struct(F.length(gap(i)).alias("gap"), F.get(F.col(kind)["hits"], i).alias("hit"), F.lower(F.right(gap(i), F.lit(CONTEXT))).alias("before"), F.left(gap(i + 1), F.lit(1)).alias("after")))
        return F.when(F.size(F.col(kind)["hits"]) > 0, each).alias(kind)

    return cut.select("doc_id", "text_hash", *map(matches, PATTERNS))


def spans(found: DataFrame) -> DataFrame:
    """kind, start, end, hit, before, after of every match, with the key of its text (each text once)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in PATTERNS])
    texts = found.where(F.coalesce(*PATTERNS).isNotNull()).dropDuplicates(["doc_id", "text_hash"])
    each = texts.select("doc_id", "text_hash", F.explode(kinds).alias("k")).where("k.m is not null")
    each = each.select("doc_id", "text_hash", "k.kind", F.posexplode("k.m").alias("i", "m")).select("doc_id", "text_hash", "kind", "i", "m.*")
    through = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", through.cast("long")).withColumn("start", F.col("end") - F.length("hit"))


def holds() -> Column:
    """Whether a base match passes its check; null for other kinds."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    part = lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(x, "^0+", "").try_cast("int"), F.lit(0)) <= 255)
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.forall(F.split("hit", "\\."), part))
        .when(F.col("kind") == "card", n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", n.between(10, 15))
    )


def remainder_97(value: Column) -> Column:
    """A bank number, its first four characters moved to the end and letters read as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(value, 5, 1_000), F.substring(value, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substr(moved, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda r, c: F.when(c < 65, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97))


def structure() -> Column:
    """Whether a candidate of the wider nets passes its own test; null for the base kinds and plain numbers."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    return (
        F.when(F.col("kind") == "bank", remainder_97(F.replace("hit", F.lit(" "), F.lit(""))) == 1)
        .when(F.col("kind") == "government", ~digits.rlike("^(000|666|9)") & ~digits.rlike("^...00") & ~digits.endswith("0000"))
        .when(F.col("kind") == "local", digits.rlike("^[2-9][0-8][0-9][2-9]") & ~digits.rlike("^....11"))
        .when(F.col("kind") == "hardware", F.col("hit").rlike("^.[02468aceACE]") & ~(F.col("hit").contains(":") & F.col("hit").contains("-")) & ~F.col("hit").rlike("^(..)(.\\1)+$"))
        .when(F.col("kind") == "spelled", F.lower("hit").rlike("\\W(com|org|net|edu|gov|mil|int|info|biz|name|app|dev|[a-z]{2})$"))
    )


def beside_base(rows: DataFrame) -> DataFrame:
    """rows with overlaps: whether a base span that holds shares characters with this one."""
    key, past = Window.partitionBy("doc_id", "text_hash"), (Window.unboundedPreceding, -1)  # frames that only grow
    before = F.max(F.when(F.col("ok"), F.col("end"))).over(key.orderBy("start", "end", "kind").rowsBetween(*past))
    after = F.min(F.when(F.col("ok"), F.col("start"))).over(key.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(*past))
    return rows.withColumn("overlaps", (F.coalesce(before, F.lit(0)) > F.col("start")) | (F.coalesce(after, F.lit(1 << 60)) < F.col("end")))


def features(rows: DataFrame) -> DataFrame:
    """rows with one small ordered integer per feature of format and context."""
    digits, letters = F.regexp_replace("hit", "[^0-9]", ""), F.regexp_replace("hit", "[^A-Za-z]", "")
    kind_of = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike("\\s$"), 1).when(c.rlike("[A-Za-z]$"), 3).when(c.rlike("[0-9]$"), 4).otherwise(2)
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    return rows.withColumns({
        "digits": F.least(F.length(digits), F.lit(20)),
        "letters": F.least(F.length(letters), F.lit(8)),
        "breaks": F.least(F.length("hit") - F.length(digits) - F.length(letters), F.lit(8)),
        "size": F.least(F.floor(F.length("hit") / 4).cast("int"), F.lit(8)),
        "plus": F.col("hit").startswith("+").cast("int"),
        "at": F.col("hit").rlike("@|[\\[(]at[\\])]").cast("int"),
        "cue": F.col("before").rlike("phone|tel|call|mobile|fax|mail|contact|card|visa|account|iban|ssn|social|address|reach|write to").cast("int"),
        "against": F.col("before").rlike("order|invoice|version|page|chapter|figure|isbn|total|price|section|article").cast("int"),
        "before_kind": kind_of(F.col("before")),
        "after_kind": kind_of(F.col("after")),
        "distinct": F.least(distinct, F.lit(10)),
    })


def decisive(kind: str) -> bool:
    """Whether a candidate that fails its generator's test can't be genuine."""
    return CHANCE[kind] < 0.1


def threshold(bins: list[tuple[float, int, int]], chance: float, passing_only: bool) -> float:
    """The lowest probability from which on candidates, or those that pass, are genuine with PRECISION; 2 if none is.

    bins: probability, candidates, those that pass. Of n candidates, y pass; if g are genuine and the others
    pass by chance, y = g + chance * (n - g).
    """
    best, n, y = 2.0, 0, 0
    for p, more, passing in sorted(bins, reverse=True):
        n, y = n + more, y + passing
        genuine = (y - chance * n) / (1 - chance)
        if y and genuine >= PRECISION * (y if passing_only else n) and p >= 0.5:
            best = p
    return best


def judged(rows: DataFrame) -> DataFrame:
    """rows (of spans(), with ok, passes and features) with p, the trees' probability, and the threshold of their kind."""
    truth = F.coalesce("ok", "passes", F.lit(False))
    # what is part of a base span says nothing, nor does a plain number that another generator proposes
    other = F.col("kind").eqNullSafe("number") & reduce(Column.__or__, [F.col("hit").rlike(f"^(?:{PATTERNS[k]})$") for k in ("local", "government", "hardware")])
    labelled = rows.where(F.coalesce("ok", F.lit(False)) | ~F.col("overlaps") & ~other).select(*FEATURE_NAMES, F.when(F.col("passes").isNotNull(), F.col("kind")).otherwise("base").alias("kind"), truth.cast("int").alias("label"), (F.pmod("text_hash", F.lit(FOLDS)) == 0).alias("calibrate"))
    vectors = stage(labelled.groupBy(*FEATURE_NAMES, "kind", "label", "calibrate").agg(F.count("*").alias("n")), "pii-vectors")
    base, trees = boosting.fit(vectors.where(~F.col("calibrate")), FEATURE_NAMES)
    p = F.round(boosting.probability(base, trees), 2)
    bins: dict[str, list] = {kind: [] for kind in ("base", *CHANCE)}
    for r in vectors.where("calibrate").groupBy("kind", p.alias("p")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("y")).collect():  # at most 101 rows of each kind
        bins[r["kind"]].append((r["p"], r["n"], r["y"]))
    common = threshold(bins["base"], 0.0, False)
    own = {kind: threshold(bins[kind], chance, decisive(kind)) if sum(n for _, n, _ in bins[kind]) >= LEAST else common for kind, chance in CHANCE.items()}
    of_kind = reduce(lambda c, k: c.when(F.col("kind") == k[0], k[1]), own.items(), F.when(F.lit(False), 2.0))
    return rows.withColumns({"p": p, "threshold": of_kind})


def reported(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key of every row of docs; key, kind, start, end of every span reported, each text once)."""
    found = stage(candidates(docs), "pii-candidates")
    rows = stage(features(beside_base(spans(found).withColumn("ok", holds()))).withColumn("passes", structure()), "pii-spans")
    base = rows.where("ok").select("doc_id", "text_hash", "kind", "start", "end", F.lit(2.0).alias("p"))
    counts = F.col("passes") | F.col("kind").isin([kind for kind in CHANCE if not decisive(kind)]) & F.col("passes").isNotNull()
    more = judged(rows).where(counts & (F.col("p") >= F.col("threshold")) & ~F.col("overlaps")).select("doc_id", "text_hash", "kind", "start", "end", "p")
    both = base.unionByName(more)
    # of candidates that overlap, the one that starts first stays, then the surer one
    reach = F.max(F.when(F.col("p") < 2.0, F.col("end"))).over(Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("p"), "kind").rowsBetween(Window.unboundedPreceding, -1))
    kept = both.withColumn("reach", reach).where((F.col("p") == 2.0) | (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    return found.select("doc_id", "text_hash"), kept.select("doc_id", "text_hash", "kind", "start", "end")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs, and n_added: the spans
    beyond the base ones."""
    every, found = reported(docs)
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(PATTERNS), F.when(F.lit(False), -1))
    listed = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    one = F.struct("start", order.alias("order"), "end", "kind")
    per_text = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(one)).alias("s"))
    per_text = stage(per_text.withColumn("b", F.filter("s", lambda x: x["order"] < len(BASE_KINDS))), "pii-texts")
    joined = every.join(per_text, [every[k].eqNullSafe(per_text[k]) for k in ("doc_id", "text_hash")], "left")
    none = F.array().cast(per_text.schema["s"].dataType)
    count = lambda kind: F.size(F.filter(F.coalesce("b", none), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE_KINDS]
    return joined.select(every["doc_id"], *counts, F.sha2(listed(F.coalesce("b", none)), 256).alias("base_sha256"), listed(F.coalesce("s", none)).alias("spans"), (F.size(F.coalesce("s", none)) - F.size(F.coalesce("b", none))).cast("long").alias("n_added"))
