"""The library's columns as SQL functions of a session: rulers, deltas between fingers, and rule costs.

`register` makes a temporary function of each: its body is the SQL of the Column that the library builds for arguments
of these names, so SQL and DataFrames share one definition. Such functions are no black boxes: Spark puts the body in
place of the call, so a query plans, prunes and compiles as if the Column had been written there.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from handspan.functions import keys, measures
from handspan.functions.dims import edit_distance
from handspan.functions.rules import RULES, Trigram

TRIGRAM = ("m1 int, m2 int, m3 int, h1 string, h2 string, h3 string, d1 int, d2 int, d3 int").split(", ")


def _body(spark: SparkSession, arguments: list[str], column: Column) -> tuple[str, str]:
    """(SQL text, type) of a Column over columns of these names."""
    row = spark.createDataFrame([], ", ".join(arguments)).select(column.alias("v"))
    plan = row._jdf.queryExecution().analyzed()
    text = plan.expressions().head().child().sql()
    for a in arguments:
        name = a.split(" ")[0]
        text = text.replace(f"__auto_generated_subquery_name.{name}", name)
    return text, row.schema["v"].dataType.simpleString()


def trigram(table: str = "parncutt", ruler: str = "semitone") -> Trigram:
    c = lambda x: [F.col(f"{x}{i}") for i in (1, 2, 3)]
    return Trigram(c("m"), c("h"), c("d"), table, ruler)


def functions_of(table: str = "parncutt", ruler: str = "semitone") -> dict[str, tuple[list[str], Column]]:
    """(arguments, Column) by function name."""
    a, b = F.col("a"), F.col("b")
    two = ["a int", "b int"]
    out = {f"distance_{name}": (two, measure(a, b)) for name, measure in keys.RULERS.items()}
    out |= {
        "distance_lattice_x": (two, keys.distance_lattice_x(a, b)), "distance_lattice_y": (two, keys.distance_lattice_y(a, b)),
        "is_black_key": (["midi int"], keys.is_black("midi")), "pitch_name": (["midi int"], keys.midi_to_pitch_name("midi")),
    }
    fingers = ["hand_a string", "digit_a int", "hand_b string", "digit_b int"]
    out |= {f"edit_{m}": (fingers, edit_distance(m, *[F.col(x.split(" ")[0]) for x in fingers])) for m in ("hamming", "natural", "pivot")}
    t = trigram(table, ruler)
    return out | {f"rule_{tag}": (list(TRIGRAM), rule(t)) for tag, rule in RULES.items()}


def register(spark: SparkSession, *, table: str = "parncutt", ruler: str = "semitone", prefix: str = "") -> list[str]:
    """Makes the temporary functions, and a table function `rule_costs` of a trigram: (rule, cost) of each rule. Gives their names."""
    names = []
    for name, (arguments, column) in functions_of(table, ruler).items():
        body, kind = _body(spark, arguments, column)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(arguments)}) RETURNS {kind} RETURN {body}")
        names.append(prefix + name)
    plain = ", ".join(a.split(" ")[0] for a in TRIGRAM)
    each = ", ".join(f"named_struct('rule', '{tag}', 'cost', CAST({prefix}rule_{tag}({plain}) AS DOUBLE))" for tag in RULES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}rule_costs({', '.join(TRIGRAM)}) RETURNS TABLE (rule STRING, cost DOUBLE) RETURN SELECT inline(costs) FROM (SELECT array({each}) AS costs)")
    return [*names, f"{prefix}rule_costs"]
