"""Matching of binary descriptors: 256 bits as four longs.

Descriptors at most ``radius`` bits apart agree in at least one of radius + 1 blocks of bits, so
candidates come from equality joins on (frame, block, bits); no frame lists all its pairs. The
distance is counted in the JVM. The join is a merge: blocks make many rows of one, which the
planner's estimate of sizes does not see, so that it would send all of them through the driver. Matches are mutual nearest ones (a tie goes to the smaller
number), nearest first, ``top`` a frame. A nearest neighbour within the radius is found for
certain, so within it the matches are those of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, BITS = 4, 64


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two rows of longs."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def blocks(words: Column, radius: int) -> Column:
    """The bits of a descriptor in blocks, of which there are more than ``radius``."""
    each = -(-(radius + 1) // WORDS)
    width = BITS // each
    if not width:
        raise ValueError("a radius of 255 bits at most")
    cut = [F.shiftrightunsigned(F.get(words, F.lit(w)), k * width).bitwiseAND(F.lit((1 << width) - 1 if k < each - 1 and width < BITS else -1).cast("long")) for w in range(WORDS) for k in range(each)]
    return F.array(*cut)


def matches(a: DataFrame, b: DataFrame, keys: list[str], radius: int = 32, top: int | None = 50) -> DataFrame:
    """a, b: keys, idx, words (array of four longs) -> keys, a_idx, b_idx, distance, rank."""
    word = lambda p: [F.col(f"{p}_{w}") for w in range(WORDS)]
    side = lambda df, p: df.select(*keys, F.col("idx").alias(f"{p}_idx"), *[F.get("words", F.lit(w)).alias(f"{p}_{w}") for w in range(WORDS)], F.posexplode(blocks(F.col("words"), radius)).alias("block", "bits"))
    met = side(a, "a").join(side(b, "b").hint("merge"), [*keys, "block", "bits"])
    near = met.select(*keys, "a_idx", "b_idx", hamming(word("a"), word("b")).alias("distance")).where(F.col("distance") <= radius).distinct()
    forth = F.row_number().over(Window.partitionBy(*keys, "a_idx").orderBy("distance", "b_idx"))
    back = F.row_number().over(Window.partitionBy(*keys, "b_idx").orderBy("distance", "a_idx"))
    mutual = near.withColumn("forth", forth).withColumn("back", back).where("forth = 1 AND back = 1").drop("forth", "back")
    ranked = mutual.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "a_idx", "b_idx")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
