"""Synthetic example tables, made by the executors from a row number and a seed: the same at any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, k: int) -> Column:
    """In (0, 1), by the row's number."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def _normal(seed: int, k: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, k))) * F.cos(2 * F.pi() * _uniform(seed, k + 500))


def _choice(u: Column, options: list[tuple[str, float]]) -> Column:
    """A name by cumulated shares."""
    ends, total = [], 0.0
    for name, share in options:
        total += share
        ends.append((name, total))
    return reduce(lambda rest, x: F.when(u < x[1], x[0]).otherwise(rest), reversed(ends[:-1]), F.lit(ends[-1][0]))


def shop(spark: SparkSession, n: int = 600, seed: int = 42) -> DataFrame:
    """Clients of a shop: segments with habits of their own, a skewed basket, two delivery modes, a duration that is shortest
    at middle age, a few resellers far out, and some unanswered questions."""
    u, z = (lambda k: _uniform(seed, k)), (lambda k: _normal(seed, k))
    segment = _choice(u(1), [("Occasionnel", 0.45), ("Régulier", 0.35), ("Fidèle", 0.17), ("Revendeur", 0.03)])
    by = lambda *values: F.element_at(F.create_map(*(F.lit(x) for pair in zip(("Occasionnel", "Régulier", "Fidèle", "Revendeur"), values, strict=True) for x in pair)), F.col("Segment"))
    age = F.round(F.greatest(F.lit(18.0), F.least(F.lit(85.0), 44 + 15 * z(4))))
    rows = spark.range(n).withColumn("Segment", segment)
    return rows.select(
        F.format_string("C%04d", F.col("id") + 1).alias("Client"),
        "Segment",
        _choice(u(2), [("Web", 0.5), ("Mobile", 0.3), ("Boutique", 0.2)]).alias("Canal"),
        _choice(u(3), [("Nord", 0.3), ("Sud", 0.3), ("Est", 0.2), ("Ouest", 0.2)]).alias("Region"),
        age.alias("Age"),
        F.round(F.greatest(F.lit(1.0), by(8.0, 30.0, 70.0, 40.0) + 10 * z(5))).alias("Anciennete_mois"),
        F.round(F.greatest(F.lit(1.0), by(2.0, 7.0, 15.0, 60.0) + by(1.0, 2.0, 3.0, 10.0) * z(6))).alias("Commandes_an"),
        F.round(F.exp(by(3.6, 3.9, 4.1, 6.2) + 0.5 * z(7)), 2).alias("Panier_moyen_EUR"),
        F.round(F.greatest(F.lit(0.0), by(4.0, 7.0, 10.0, 18.0) + 2 * z(8)), 1).alias("Taux_remise_pct"),
        F.round(F.greatest(F.lit(1.0), by(3.0, 8.0, 14.0, 30.0) + 2 * z(9))).alias("Visites_mois"),
        F.round(F.greatest(F.lit(1.0), 4 + (age - 45) * (age - 45) / 60 + 1.5 * z(10)), 1).alias("Duree_session_min"),
        F.round(F.greatest(F.lit(0.0), 6 + 3 * z(11)), 1).alias("Taux_retour_pct"),
        F.round(F.greatest(F.lit(1.0), F.when(u(12) < 0.55, 2.5 + 0.6 * z(13)).otherwise(7 + 0.8 * z(13))), 1).alias("Delai_livraison_j"),
        F.when(u(14) >= 0.04, F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), by(6.0, 7.0, 8.0, 6.5) + z(15))), 1)).alias("Satisfaction"),
    )


#: The answers of a survey by column; people of a type give its typical answer seven times out of ten.
SURVEY = {
    "Age": ["18-29", "30-44", "45-59", "60+"],
    "Canal": ["Boutique", "Site", "Salon", "Revendeur"],
    "Achat_prefere": ["Robe", "Sac", "Bijou", "Parfum"],
    "Frequence": ["Rare", "Annuelle", "Mensuelle"],
    "Motivation": ["Cadeau", "Qualité", "Mode", "Prix"],
}


def survey(spark: SparkSession, n: int = 90, seed: int = 7) -> DataFrame:
    """Categorical answers of people of as many types as a question has answers."""
    kind = F.pmod(F.col("id"), F.lit(4))

    def answer(k: int, names: list[str]) -> Column:
        options = F.array(*map(F.lit, names))
        other = F.floor(_uniform(seed, 20 + k) * len(names)) + 1
        return F.element_at(options, F.when(_uniform(seed, k) < 0.7, F.pmod(kind, F.lit(len(names))) + 1).otherwise(other).cast("int"))

    return spark.range(n).select(F.format_string("P%03d", F.col("id") + 1).alias("Client"), *(answer(k, v).alias(c) for k, (c, v) in enumerate(SURVEY.items())))


EXAMPLES = {"shop": shop, "survey": survey}
