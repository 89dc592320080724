"""Rule evaluation: rules are rows on the driver that become column expressions.

A document meets all rules in one pass without a join; the expression grows
with the rules, not with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrome.functions import patterns as P
from veridrome.functions import scores as S
from veridrome.functions import text as T


@dataclass(frozen=True)
class Rule:
    """A rule: ``kind`` is regex, keyword or terms; keywords may count whole words only."""

    id: str
    kind: str
    severity: str = "medium"
    pattern: str = ""
    keywords: tuple[str, ...] = ()
    whole_word: bool = False
    framework: str = ""
    languages: tuple[str, ...] = ()
    weight: float = 1.0
    extra: dict = field(default_factory=dict, compare=False)


def score(rule: Rule, text: Column) -> Column:
    """Score of a text under a rule: 1 is clean.

    regex: 0 with any match; keyword: 1 - 0.2 a hit (overlapping hits count);
    terms: 1 - 0.25 a term found.  Then to the power of the severity.
    """
    if rule.kind == "regex":
        s = F.when(text.rlike(P.check(rule.pattern)), 0.0).otherwise(1.0)
    elif rule.kind == "keyword":
        hits = T.whole_word_count(text, list(rule.keywords)) if rule.whole_word else sum(T.overlapping_count(text, k) for k in rule.keywords)
        s = F.greatest(F.lit(0.0), 1 - hits * 0.2)
    elif rule.kind == "terms":
        s = F.greatest(F.lit(0.0), 1 - T.n_terms_found(text, list(rule.keywords)) * 0.25)
    else:
        raise ValueError(f"unknown kind of rule: {rule.kind}")
    return F.pow(s, F.lit(S.EXPONENT[rule.severity]))


def hit(rule: Rule, text: Column) -> Column:
    """Whether a rule applies to a text at all."""
    return text.rlike(P.check(rule.pattern)) if rule.kind == "regex" else T.contains_any(text, list(rule.keywords))


def verdicts(df: DataFrame, key: str, text: str, rules: list[Rule], mode: str = "standard", lang: str | None = None) -> DataFrame:
    """(key, rule_id, framework, severity, score, violated) for each text and rule that speaks its language."""
    limit = S.MODES[mode]
    rows = []
    for r in rules:
        s = F.round(score(r, F.col(text)), 6)
        row = F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.framework).alias("framework"), F.lit(r.severity).alias("severity"), s.alias("score"), (s < limit).alias("violated"))
        rows.append(F.when(F.col(lang).isin(*r.languages), row) if lang and r.languages else row)
    return df.select(key, F.explode(F.array_compact(F.array(*rows))).alias("v")).select(key, "v.*")


def document_scores(v: DataFrame, key: str, mode: str = "standard") -> DataFrame:
    """Mean score, number of violations and verdict of each text."""
    g = v.groupBy(key).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count_if("violated").alias("n_violations"))
    return g.withColumn("compliant", F.col("mean_score") >= S.MODES[mode])


def framework_rollup(v: DataFrame, key: str) -> DataFrame:
    """Per text: all compliant, least score, violations per framework as a sorted list."""
    g = v.groupBy(key, "framework").agg(F.min("score").alias("least"), F.count_if("violated").alias("n"))
    hits = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.concat("framework", F.lit(":"), F.col("n").cast("string")))))
    return g.groupBy(key).agg((F.sum("n") == 0).alias("compliant"), F.min("least").alias("least_score"), F.array_join(hits, ",").alias("violations"))


def first_hit(df: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """The first rule, in their order, that applies to each text (null if none)."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(hit(r, F.col(text)), F.lit(r.id)).otherwise(out)
    return df.select(key, out.alias("rule_id"))


def keyword_confidence(text: Column, keywords: list[str]) -> Column:
    """0.7 + 0.3 times the share of the keywords found; 0 if none."""
    n = T.n_terms_found(text, keywords)
    return F.when(n > 0, 0.7 + 0.3 * n / len(keywords)).otherwise(0.0)


def contextual(content: Column, context: Column) -> Column:
    """0.3 content + 0.7 context."""
    return 0.3 * content + 0.7 * context


def weighted_share(text: Column, weights: dict[str, float]) -> Column:
    """Share of the keywords' weight that occurs in a text."""
    total = sum(weights.values())
    low = F.lower(text)
    return sum(F.when(low.contains(k.lower()), w).otherwise(0.0) for k, w in weights.items()) / total


def combine(parts: list[Column], how: str, weights: list[float] | None = None, threshold: float = 0.65) -> Column:
    """all, any, majority or weighted over scores that count from ``threshold``."""
    met = [p >= threshold for p in parts]
    n = sum(F.when(m, 1).otherwise(0) for m in met)
    if how == "all":
        return n == len(parts)
    if how == "any":
        return n > 0
    if how == "majority":
        return n * 2 > len(parts)
    ws = weights or [1.0] * len(parts)
    return sum(p * w for p, w in zip(parts, ws)) / sum(ws) >= threshold


def override(base: DataFrame, *layers: DataFrame, key: str = "id") -> DataFrame:
    """Rules of later layers replace those of earlier ones by id; extra columns must agree."""
    from pyspark.sql.window import Window

    all_rows = base.withColumn("_layer", F.lit(0))
    for i, df in enumerate(layers, 1):
        all_rows = all_rows.unionByName(df.withColumn("_layer", F.lit(i)))
    w = Window.partitionBy(key).orderBy(F.desc("_layer"))
    return all_rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_layer")


@dataclass(frozen=True)
class Inference:
    """A conclusion that follows from premises in the absence of others."""

    premises: tuple[str, ...]
    conclusion: str
    excluded: tuple[str, ...] = ()


def forward_chain(facts: Column, rules: list[Inference], rounds: int = 10) -> Column:
    """All facts that follow, rules taken in their order within a round, at most ``rounds`` rounds.

    The rounds are unrolled only as deep as conclusions can feed premises.
    """
    made = {r.conclusion for r in rules}
    depth = min(rounds, 1 + len(made & {p for r in rules for p in r.premises + r.excluded}))
    order = F.array(*[F.struct(F.array(*[F.lit(p) for p in r.premises]).alias("p"), F.array(*[F.lit(x) for x in r.excluded]).cast("array<string>").alias("x"), F.lit(r.conclusion).alias("c")) for r in rules])
    program = F.flatten(F.array_repeat(order, depth))

    def step(f: Column, r: Column) -> Column:
        ready = (F.size(F.array_except(r["p"], f)) == 0) & ~F.arrays_overlap(r["x"], f)
        return F.when(F.coalesce(ready, F.lit(False)), F.array_union(f, F.array(r["c"]))).otherwise(f)

    return F.aggregate(program, facts, step)


def premises(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))


def instantiate(templates: DataFrame, template: str, values: dict[str, str]) -> DataFrame:
    """Fill ``{name}`` places of a template column from other columns."""
    return templates.withColumn(template, T.fill(F.col(template), {k: F.col(c) for k, c in values.items()}))
