"""License scan by ordered signature rules, on DataFrame functions alone.

Texts become lower-case words joined by single spaces. A rule is tried on the texts that have its keyword, a
word of every match that follows from the rule's own expression. Every rule is a literal expression of its
own, so it is compiled once; where one matches, its word intervals are listed. An interval inside another
one of the same or a higher priority is suppressed (of equal intervals the higher priority, then the earlier
rule, stays). Base phrases are always reported.

All of this happens within a document's row, in the stage that scans the table: nothing is shuffled, joined
or kept, and each row stands for itself.

Defined results: null and wordless texts have zero words, no labels, score 0 and null word numbers; repeated
rows, and null and repeated doc_ids, get a row each; other columns are ignored; an empty table gives no rows.
score is the highest confidence of what was found.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, split_words
from lodestone.llm.license_rules import TAG, rules

SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.5
#: Put around matches; no word holds them, as they separate words.
OPEN, CLOSE = "\x01", "\x02"


def whole_words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def once(value: Column, use) -> Column:
    """use(value), with value computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def marked(norm: Column, pattern: Column) -> Column:
    """The words of norm, where the first of each match begins with OPEN and the last ends with CLOSE."""
    return F.split(F.regexp_replace(norm, pattern, F.lit(f"{OPEN}$0{CLOSE}")), " ")


def places(words: Column, test) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())


def starts(words: Column) -> Column:
    return places(words, lambda w: w.startswith(OPEN))


def ends(words: Column) -> Column:
    """Numbers of the last words of the matches."""
    return places(words, lambda w: w.endswith(CLOSE))


def literals(values) -> Column:
    """A constant array; numbers, or strings without quotes. One expression, as the session's gateway is slow."""
    return F.expr(f"array({', '.join(raw(v) if isinstance(v, str) else repr(v) for v in values)})")


def raw(value: str) -> str:
    return f"r'{value}'"


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, n_words of every row; norm (its words joined by spaces) and rules (the numbers of those whose
    keyword it has) where it has any word of a base phrase or a keyword."""
    index = defaultdict(list)
    for i, rule in enumerate(rules()):
        for word in rule.keyword.split("|"):
            index[word].append(i)
    known = literals(sorted({*index, *(phrase.split(" ")[0] for phrase in BASE)}))
    table = F.expr(f"map({', '.join(f'{raw(word)}, array({str(numbers)[1:-1]})' for word, numbers in sorted(index.items()))})")
    none = F.array().cast("array<int>")
    lower = docs.select(F.col("doc_id").cast("long"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lower"))
    words = lower.select("doc_id", split_words(F.col("lower"), SEPARATORS).alias("words"))
    met = words.select("doc_id", "words", F.array_intersect("words", known).alias("met"))
    some = F.size("met") > 0
    return met.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.when(some, F.array_join("words", " ")).alias("norm"),
        F.when(some, F.flatten(F.transform("met", lambda w: F.coalesce(F.element_at(table, w), none)))).alias("rules"),
    )


def matching(norm: str, numbers: str) -> Column:
    """Of the numbered rules, those with a match in norm, in order."""
    tried = ", ".join(f"if(array_contains(x.rules, {i}) and x.norm rlike {raw(whole_words(rule.pattern))}, {i}, null)" for i, rule in enumerate(rules()))
    return F.expr(f"case when size({numbers}) > 0 then transform(array(struct({norm} as norm, {numbers} as rules)), x -> array_compact(array({tried})))[0] end")


def intervals(norm: Column, hits: Column) -> Column:
    """start, end, priority (the last two negated, so that this is the order of suppression) and rule of every
    match of the rules in hits; end is exclusive."""
    patterns, priorities = literals(whole_words(rule.pattern) for rule in rules()), literals(rule.priority for rule in rules())

    def of_rule(i: Column) -> Column:
        def listed(words: Column) -> Column:
            return F.transform(F.arrays_zip(starts(words).alias("a"), ends(words).alias("b")), lambda x: F.struct(x["a"].alias("start"), (-x["b"] - 1).alias("minus_end"), (-F.get(priorities, i)).alias("minus_priority"), i.alias("rule")))

        return once(marked(norm, F.get(patterns, i)), listed)

    return F.sort_array(F.flatten(F.transform(hits, of_rule)))


def surviving(ordered: Column) -> Column:
    """The distinct rules with an interval that lies in no other of the same or a higher priority. Intervals come
    by start, so one lies in an earlier one if that reaches its end; reach has the furthest end by priority."""
    begin = F.struct(F.array(*[F.lit(0)] * (TAG + 1)).alias("reach"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        reach = F.transform(state["reach"], lambda r, p: F.when(p <= -x["minus_priority"], F.greatest(r, -x["minus_end"])).otherwise(r))
        stays = F.get(state["reach"], -x["minus_priority"]) < -x["minus_end"]
        return F.struct(reach.alias("reach"), F.when(stays, F.array_union(state["kept"], F.array(x["rule"]))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(ordered, begin, step, lambda state: state["kept"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs."""
    gated = normalised(docs)
    hit = gated.withColumns({"base": F.when(F.col("norm").isNotNull(), marked(F.col("norm"), F.lit(whole_words("|".join(BASE))))), "hits": matching("norm", "rules")})
    found = hit.select("doc_id", "n_words", F.col("base"), starts(F.col("base")).alias("at"), F.when(F.size("hits") > 0, surviving(intervals(F.col("norm"), F.col("hits")))).alias("kept"))
    no_names = F.array().cast("array<string>")
    base = F.concat(*[F.when(F.array_contains("base", OPEN + phrase.split(" ")[0]), F.array(F.lit(label))).otherwise(no_names) for phrase, label in BASE.items()])
    labels, confidences = literals(rule.label for rule in rules()), literals(rule.confidence for rule in rules()).cast("array<double>")
    named = found.select(
        "doc_id", "n_words", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce(base, no_names).alias("base"),
        F.coalesce(F.transform("kept", lambda i: F.get(labels, i)), no_names).alias("more"), F.array_max(F.transform("kept", lambda i: F.get(confidences, i))).alias("best"),
    )
    return named.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.get("at", 0).cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("base", "more")), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("at") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0)).alias("score"),
    )
