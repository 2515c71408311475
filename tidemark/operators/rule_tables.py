"""Classification by rule tables of any length: rules meet the entities by keys of an inverted index, not as literals.

A rule has a ``kind`` (what it says), a ``field`` (which text it looks at), a ``form`` (how) and a ``value``. Forms are ``whole``,
``prefix``, ``suffix``, ``contains`` and ``regex``. Every rule is filed under one key: the whole value, its first or last GRAM
characters, or that one of its character strings which the fewest entities have; a regular expression under a string that
every match holds. Entities are looked up under all keys of their texts, and what meets is checked exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.spread import all_of
from tidemark.params import DEFAULT_RULES, RuleSet
from tidemark.session import materialise

RULES = "kind string, field string, form string, value string"
FORMS = ("whole", "prefix", "suffix", "contains", "regex")
#: What rules of a kind look at: lower-case texts.
FIELDS = ("id", "symbol", "id_name", "id_name_symbol")
KINDS = ("allowed", "stable", "wrapped", "base", "derivative", "base_text", "derivative_text")
#: Characters of a key of parts of a text.
GRAM = 4
#: Regular expressions without a string that every match holds; they are tried on every entity.
MOST_KEYLESS = 1000

_ITEM = re.compile(r"\\.|\[\^?\]?[^\]]*\]|\{[^}]*\}|.", re.S)


def needed_text(pattern: str) -> str | None:
    """The longest string that every match of a pattern holds; None where the pattern is not simple enough to tell."""
    items = _ITEM.findall(pattern)
    if any(i in "()|" for i in items):
        return None
    runs, run = [], ""
    for item, after in zip(items, [*items[1:], ""]):
        literal = item if len(item) == 1 and item not in ".^$?*+" else item[1] if item[0] == "\\" and not item[1].isalnum() else None
        optional = after[:1] in ("?", "*") or (after[:1] == "{" and len(after) > 1)
        if literal is None or optional:  # what stands here is not certain
            runs.append(run)
            run = ""
            continue
        run += literal
        if after == "+":
            runs.append(run)
            run = ""
    return max([*runs, run], key=len) or None


def pattern_rules(kind: str, field: str, pattern: str) -> list[tuple[str, str, str, str]]:
    """Rules that together match where ``pattern`` does (ignoring case): plain ones where its alternatives are plain."""
    out = []
    for part in pattern.split("|") if not re.search(r"[()\[\\]", pattern) else [pattern]:
        body, form = part, "contains"
        if body.startswith("^"):
            body, form = body[1:], "prefix"
        if body.endswith("$") and not body.endswith("\\$"):
            body, form = body[:-1], "whole" if form == "prefix" else "suffix"
        if body and not re.search(r"[\\^$.|?*+()\[\]{}]", body):
            out.append((kind, field, form, body.lower()))
        else:
            out.append((kind, field, "regex", part))
    return out


def rule_rows(rules: RuleSet = DEFAULT_RULES) -> list[tuple[str, str, str, str]]:
    """The rows of a rule table that says the same as a ``RuleSet``."""
    whole: list[tuple[str, str, Iterable[str]]] = [
        ("allowed", "id", rules.allowed),
        ("allowed", "symbol", rules.allowed),
        ("stable", "id", rules.stable_ids),
        ("stable", "symbol", rules.stable_symbols),
        ("wrapped", "id", rules.wrapped_ids),
        ("base", "id", rules.base_ids),
        ("base", "symbol", rules.base_ids),
        ("derivative", "id", rules.derivative_symbols),
        ("derivative", "symbol", rules.derivative_symbols),
    ]
    out = [(kind, field, "whole", value) for kind, field, values in whole for value in values]
    for pattern in rules.wrapped_patterns:
        out += pattern_rules("wrapped", "id_name", pattern)
    out += pattern_rules("base_text", "id_name_symbol", rules.base_pattern)
    return out + pattern_rules("derivative_text", "id_name_symbol", rules.derivative_pattern)


def rule_table(spark: SparkSession, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(rule_rows(rules), RULES)


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """All strings of the given lengths within a text."""
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda at: F.substring(text, at, F.lit(n)))).otherwise(none)

    found = [of_length(n) for n in lengths] or [none]
    return F.array_distinct(F.flatten(F.array(*found)))


def _texts(entities: DataFrame, id_col: str, name_col: str, symbol_col: str) -> DataFrame:
    """Distinct ``field, text`` of the entities."""
    columns = _fields(id_col, name_col, symbol_col)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in columns.items()]))
    return entities.select(pairs.alias("p")).select("p.field", "p.text").distinct()


def _fields(id_col: str, name_col: str, symbol_col: str) -> dict[str, Column]:
    i, n, s = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (id_col, name_col, symbol_col))
    return {"id": i, "symbol": s, "id_name": F.concat_ws(" ", i, n), "id_name_symbol": F.concat_ws(" ", i, n, s)}


def matches(entities: DataFrame, rules: DataFrame, id_col: str = "id", name_col: str = "name", symbol_col: str = "symbol") -> DataFrame:
    """``field, text, kind``: which kinds of rules match which texts of the entities. Each triple occurs once.

    Rules whose value is NULL or empty match nothing. Texts and values are compared in lower case.
    """
    texts = materialise(_texts(entities, id_col, name_col, symbol_col), "rule-texts")
    known = rules.filter(F.col("value").isNotNull() & (F.col("value") != "")).select("kind", "field", "form", "value").distinct()
    needed = F.udf(needed_text, "string")
    plain = known.filter(F.col("form") != "regex").withColumn("value", F.lower("value")).withColumn("held", F.col("value"))
    regexes = known.filter(F.col("form") == "regex").withColumn("held", F.lower(needed(F.col("value"))))
    filed = materialise(plain.unionByName(regexes), "rules")

    parts = filed.filter(F.col("form").isin("contains", "regex") & F.col("held").isNotNull())
    candidates = parts.select("*", F.explode(_grams(F.col("held"), [GRAM])).alias("gram"))
    short = parts.filter(F.length("held") < GRAM).withColumn("gram", F.col("held"))
    candidates = materialise(candidates.unionByName(short), "rule-strings")
    # Only strings that some rule could be filed under are counted; one row of a text for each of them.
    wanted = candidates.select("field", "gram").distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())  # at most GRAM
    held = texts.select("field", "text", F.explode(_grams(F.col("text"), lengths)).alias("gram"))
    held = materialise(held.join(wanted, ["field", "gram"], "left_semi"), "text-strings")
    counted = held.groupBy("field", "gram").agg(F.count("*").alias("n"))
    rarest = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    filed_parts = candidates.join(counted, ["field", "gram"]).groupBy("kind", "field", "form", "value").agg(rarest)
    by_part = held.join(filed_parts, ["field", "gram"])

    def by_end(form: str, end) -> DataFrame:
        own = filed.filter(F.col("form") == form).withColumn("gram", end(F.col("value"), GRAM))
        sizes = sorted(r[0] for r in own.select(F.length("gram")).distinct().collect())  # at most GRAM
        keys = F.explode(F.array(*[end(F.col("text"), n) for n in sizes]).cast("array<string>"))
        return texts.select("field", "text", keys.alias("gram")).join(own.drop("held"), ["field", "gram"])

    first = by_end("prefix", lambda c, n: F.substring(c, 1, n))
    last = by_end("suffix", lambda c, n: F.right(c, F.lit(n)))
    columns = ["field", "text", "kind", "form", "value"]
    met = first.select(columns).unionByName(last.select(columns)).unionByName(by_part.select(columns))
    text, value = F.col("text"), F.col("value")
    exact = (
        F.when(F.col("form") == "prefix", F.startswith(text, value))
        .when(F.col("form") == "suffix", F.endswith(text, value))
        .when(F.col("form") == "contains", F.contains(text, value))
        .otherwise(F.regexp(text, F.concat(F.lit("(?i)"), value)))
    )
    found = met.filter(exact).select("field", "text", "kind")
    whole = filed.filter(F.col("form") == "whole").select("field", "kind", F.col("value").alias("text"))
    found = found.unionByName(texts.join(whole, ["field", "text"]).select("field", "text", "kind"))
    keyless = filed.filter("form = 'regex' AND held IS NULL").limit(MOST_KEYLESS + 1).collect()
    if len(keyless) > MOST_KEYLESS:
        raise ValueError(f"more than {MOST_KEYLESS} regular expressions hold no certain string")
    for kind, field in sorted({(r["kind"], r["field"]) for r in keyless}):
        either = "(?i)" + "|".join(f"(?:{r['value']})" for r in keyless if (r["kind"], r["field"]) == (kind, field))
        here = texts.filter((F.col("field") == field) & F.col("text").rlike(either))
        found = found.unionByName(here.select("field", "text", F.lit(kind).alias("kind")))
    return found.distinct()


def classify_by_tables(
    entities: DataFrame,
    rules: DataFrame,
    purpose: str = "download",
    reasons: RuleSet = DEFAULT_RULES,
    id_col: str = "id",
    name_col: str = "name",
    symbol_col: str = "symbol",
    reason_col: str = "reason",
) -> DataFrame:
    """``operators.classify.classify`` with rules from a table (``kind, field, form, value``) instead of literals.

    Add ``reason`` (NULL = keep) for ``purpose`` "download" or "index"; ``reasons`` gives the wording. Rows and columns are
    kept as they are, repeated entities included. For lists of thousands of rules; short ones are faster as literals.
    """
    if purpose not in ("download", "index"):
        raise ValueError("purpose must be download or index")
    found = materialise(matches(entities, rules, id_col, name_col, symbol_col), "rule-matches")
    by_text = found.groupBy("field", "text").agg(F.collect_set("kind").alias("kinds"))  # at most the kinds there are
    rows = entities.withColumns({f"_{f}": c for f, c in _fields(id_col, name_col, symbol_col).items()})
    every = F.array().cast("array<string>")
    for field in FIELDS:
        kinds = by_text.filter(F.col("field") == field).select(F.col("text").alias(f"_{field}"), F.col("kinds").alias(f"_k_{field}"))
        rows = rows.join(kinds, f"_{field}", "left")
        every = F.concat(every, F.coalesce(F.col(f"_k_{field}"), F.array().cast("array<string>")))

    def has(*kinds: str) -> Column:
        return all_of([F.array_contains("_kinds", k) for k in kinds])

    rows = rows.withColumn("_kinds", every)
    chain = F.when(has("allowed"), F.lit(None).cast("string"))
    if purpose == "index":
        chain = chain.when(has("base"), F.lit(reasons.base_reason))
    derivative = ~has("base") & (has("derivative") | has("base_text", "derivative_text"))
    chain = (
        chain.when(has("stable"), F.lit(reasons.stable_reason))
        .when(has("wrapped"), F.lit(reasons.wrapped_reason))
        .when(derivative, F.lit(reasons.derivative_reason))
    )
    return rows.select(*entities.columns, chain.alias(reason_col))
