"""Pairs to train outside models on, and decisions by country."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import decide


def positives(truth: DataFrame, per_query: int = 2, exclude: DataFrame | None = None) -> DataFrame:
    """(q_id, p_id): at most ``per_query`` true pairs of a query, in hash order; queries of ``exclude`` are left out."""
    t = truth if exclude is None else truth.join(exclude.select("q_id").distinct(), "q_id", "left_anti")
    w = Window.partitionBy("q_id").orderBy(F.md5(F.concat("q_id", F.lit(" "), "p_id").cast("binary")), "p_id")
    return t.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_query).select("q_id", "p_id")


def hard_negatives(candidates: DataFrame, truth: DataFrame, k: int = 8, exclude: DataFrame | None = None) -> DataFrame:
    """(q_id, p_id, y): every candidate of rank below k, labelled by the truth; queries of ``exclude`` are left out."""
    c = candidates.filter(F.col("rank") < k)
    c = c if exclude is None else c.join(exclude.select("q_id").distinct(), "q_id", "left_anti")
    y = c.join(truth.select("q_id", "p_id", F.lit(1).alias("y")), ["q_id", "p_id"], "left")
    return y.select("q_id", "p_id", F.coalesce("y", F.lit(0)).cast("long").alias("y"))


def ciphered(texts: DataFrame, columns: list[str], alphabet: str = "abcdefghijklmnopqrstuvwxyz", shift: int = 11) -> DataFrame:
    """The same rows with the letters of some columns exchanged by a fixed shift: structure without known words."""
    turned = alphabet[shift:] + alphabet[:shift]
    return texts.withColumns({c: F.translate(c, alphabet, turned) for c in columns})


@dataclass(frozen=True)
class Decision:
    """Thresholds by country; a country that has none uses the fallback."""

    by_country: dict[str, tuple[float, float]] = field(default_factory=dict)
    fallback: tuple[float, float] = (0.7, 0.7)
    assign: bool = True

    @staticmethod
    def read(rows: DataFrame, **overrides) -> Decision:
        """From a table (country, gate, extra), one row a country."""
        return Decision({r.country: (r.gate, r.extra) for r in rows.select("country", "gate", "extra").collect()} | overrides)

    def apply(self, pairs: DataFrame) -> DataFrame:
        """Kept pairs of (country, q, p, s): the gate rule with the country's thresholds, then one owner within the country."""
        out = None
        named = list(self.by_country)
        for country in [*named, None]:
            gate, extra = self.by_country.get(country, self.fallback)
            own = pairs.filter(F.col("country") == country) if country else pairs.filter(~F.col("country").isin(named) if named else F.lit(True))
            kept = decide.gate_extra(own, gate, extra)
            out = kept if out is None else out.unionByName(kept)
        if not self.assign:
            return out
        return decide.one_owner(out, ("country",))
