"""Similarity join of sets by a prefix filter.

Tokens of a set are put in order, rare ones first. Two sets with a Jaccard likeness of
``least`` or more share a token among the first n - ceil(least * n) + 1 of each, so only
sets that meet on such a token are candidates. Tokens that one set alone has come first
and meet nothing: they are counted, not shuffled again, and a set whose prefix holds
nothing else is done. Candidates meet on a token and a class of sizes, as sets that are
alike have sizes within ``least`` of each other, and go if the tokens behind their last
common one can't make up for what is missing.

What moves is kept small: each token is dealt once, as two numbers, where it is counted and
those that one set alone has end; of the rows' own columns only those of sets that have met
move again.

Equal sets are one class and meet once; classes are told apart by SHA-256 of their
sorted tokens. In between, tokens are 64-bit hashes; what is left is decided on the
tokens themselves.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.names import free_names
from tessera.operators.written import written


def _sets(rows: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, tokens (different ones) and node (the set's SHA-256) of each row; the tokens and node of null are null.

    Tokens stay in their order, as neighbouring shingles have words in common and so take less room.
    """

    def told(found: Column) -> Column:
        return F.struct(found.alias("tokens"), F.unhex(F.sha2(F.to_json(F.array_sort(found)).cast("binary"), 256)).alias("node"))

    found = F.transform(F.array(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))), told)
    return rows.select(F.col(id_col).alias("id"), F.inline(found))


def _number(salt: int) -> Column:
    return F.xxhash64("node", F.lit(salt))


class SimilarSets:
    """Classes of equal sets of ``rows``, and the pairs of classes whose likeness is at least ``least``.

    tokens: an array of strings; repeated tokens and nulls in it count once and not at all.
    """

    def __init__(self, rows: DataFrame, id_col: str, tokens: Column, least: float):
        if not 0 < least <= 1:
            raise ValueError("least must be over 0 and at most 1")
        self.rows, self.id_col, self.tokens, self.least = rows, id_col, tokens, least
        sets = _sets(rows, id_col, tokens)
        self.hashed = written(sets.select("id", "node", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")), "sets").where(F.size("tokens") > 0)
        self.classes = written(self.hashed.groupBy("node").agg(F.min("id").alias("class_id"), F.first(F.size("tokens")).alias("n")), "classes")

    def members(self) -> DataFrame:
        """id and class_id, the least id with the same set, of each row whose set isn't empty."""
        return self.hashed.select("id", "node").join(self.classes.select("node", "class_id"), "node").select("id", "class_id")

    def _salt(self) -> int:
        """By which nodes' numbers of 64 bits are all different."""
        return next(k for k in count() if self.classes.groupBy(_number(k)).count().where("count > 1").isEmpty())

    def _prefixes(self, salt: int) -> DataFrame:
        """number (of a node), n, token and place of the tokens that may start a meeting."""
        rows = self.hashed.select(_number(salt).alias("number"), F.explode("tokens").alias("token"))
        # A set has a token once, so no token has more rows than there are rows of the table.
        # Equal sets are next to each other in the one sort that the count needs, too.
        nth = F.row_number().over(W.partitionBy("token", "number").orderBy("number"))
        met = rows.repartition("token").withColumn("nth", nth).where("nth = 1").drop("nth")
        held = met.withColumn("held", F.count(F.lit(1)).over(W.partitionBy("token"))).where("held > 1")
        shared = held.join(self.classes.select(_number(salt).alias("number"), "n"), "number")
        over = W.partitionBy("number").orderBy("held", "token")
        own = W.partitionBy("number")
        # Tokens that no other set has stand before these.
        placed = shared.withColumn("place", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(over) - 1)
        return placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * self.least - 1e-9)).select("number", "n", "token", "place")

    def candidates(self) -> DataFrame:
        """Pairs of nodes (a, b) that the filters leave."""
        salt = self._salt()
        prefixes = written(self._prefixes(salt), "prefixes")
        # Sizes within ``least`` of each other are in one class or in neighbouring ones.
        step = F.floor(F.log(F.col("n").cast("double")) / -math.log(self.least) + 1e-9) if self.least < 1 else F.col("n").cast("long")
        left = prefixes.withColumn("step", step).select("token", "step", *[F.col(c).alias(f"a_{c}") for c in ("number", "n", "place")])
        right = prefixes.withColumn("step", F.explode(F.array(step - 1, step, step + 1))).select("token", "step", *[F.col(c).alias(f"b_{c}") for c in ("number", "n", "place")])
        met = left.join(right, ["token", "step"]).where((F.col("a_number") < F.col("b_number")) & (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * self.least - 1e-9))
        pairs = met.groupBy("a_number", "b_number").agg(F.count(F.lit(1)).alias("common"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.max("a_place").alias("a_place"), F.max("b_place").alias("b_place"))
        most = F.col("common") + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) - 1
        left_over = pairs.where(most >= (F.col("a_n") + F.col("b_n")) * (self.least / (1 + self.least)) - 1e-9).select("a_number", "b_number")
        for side in ("a", "b"):
            left_over = left_over.join(self.classes.select(_number(salt).alias(f"{side}_number"), F.col("node").alias(side)), f"{side}_number")
        return left_over.select("a", "b")

    def pairs(self) -> DataFrame:
        """left_id and right_id (class_ids, the lesser first), common and total (tokens in both, and in either) of each pair of classes."""
        met = written(self.candidates(), "candidates")
        wanted = met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct()
        chosen = written(self.classes.select("node", "class_id").join(wanted, "node", "left_semi"), "chosen")
        # By the rows' own columns first: tokens take several times the room of what they come from.
        (own,) = free_names("class", self.rows)
        ids = chosen.select(F.col("class_id").alias(own)).distinct()
        rows = self.rows.join(ids, self.rows[self.id_col].eqNullSafe(ids[own]), "left_semi")
        sets = _sets(rows, self.id_col, self.tokens).join(chosen, "node").where(F.col("id").eqNullSafe(F.col("class_id")))
        sets = written(sets.select("node", "class_id", "tokens").dropDuplicates(["node"]), "wanted")
        both = met
        for side in ("a", "b"):
            both = both.join(sets.select(F.col("node").alias(side), F.col("class_id").alias(f"{side}_id"), F.col("tokens").alias(f"{side}_tokens")), side)
        n = both.select("a_id", "b_id", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long").alias("common"), (F.size("a_tokens") + F.size("b_tokens")).cast("long").alias("sizes"))
        n = n.withColumn("total", F.col("sizes") - F.col("common")).where(F.col("common") >= F.col("total") * self.least - 1e-9)
        return n.select(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "common", "total")


def similar_sets(rows: DataFrame, id_col: str, tokens: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and pairs of classes (left_id, right_id, common, total) of ``SimilarSets``.

    Rows whose tokens are null, or none, are in no class. Equal sets share a class, however
    many rows have them; rows with one id are told apart by their sets. An empty table gives
    empty results; other columns aren't read.
    """
    found = SimilarSets(rows, id_col, tokens, least)
    return found.members(), found.pairs()


def shingles(text: Column, size: int) -> Column:
    """Runs of ``size`` words of a text, joined by single spaces; all words, if they are fewer; none of a text without words."""

    def runs(words: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(F.size(words) >= size, own).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # As an element of an array the words are found once, not for each run.
    return F.element_at(F.transform(F.array(words), runs), 1)
