"""Tokens, hashes and chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.config import ChunkConfig

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"  # the C locale's white space, not Unicode's

# Fixed values of the 64-bit hash: its starting value and its prime, 2^40 + 435.
FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211
_WORD = 1 << 32


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of characters other than white space; null for null."""
    return F.filter(F.split(ascii_lower(text), BLANKS), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, chunk_no, start_token, end_token, text)`` of windows over each text's tokens.

    Texts without tokens, and null texts, have no chunk.  The last chunk is the first that
    reaches the end.  Narrow: no shuffle.
    """
    window, overlap = config.effective
    step = window - overlap
    toks = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    n = F.size("_t")
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(step)).cast("int"))
    starts = toks.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_no") * step
    return starts.select(
        "doc_id",
        "chunk_no",
        start.alias("start_token"),
        F.least(n, start + window).alias("end_token"),
        F.array_join(F.slice("_t", start + 1, F.lit(window)), " ").alias("text"),
    )


def fnv_halves(token: Column) -> Column:
    """Struct ``(hi, lo)``: the 64-bit hash of the token's UTF-8 bytes as two 32-bit numbers.

    With the low half x after the exclusive or, the product with 2^40 + 435 is x*435 plus
    x*256 and hi*435 in the high half; all of it stays within 64 bits.
    """
    digits = F.hex(token.cast("binary"))
    n = F.octet_length(token)
    byte = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    values = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), byte)).otherwise(
        F.array().cast("array<bigint>")
    )
    start = F.struct(
        F.lit(FNV_BASIS // _WORD).cast("bigint").alias("hi"), F.lit(FNV_BASIS % _WORD).cast("bigint").alias("lo")
    )

    def step(state: Column, b: Column) -> Column:
        x = state["lo"].bitwiseXOR(b)
        low = x * 435
        hi = (F.shiftrightunsigned(low, 32) + state["hi"] * 435 + x * 256) % _WORD
        return F.struct(hi.alias("hi"), (low % _WORD).alias("lo"))

    return F.aggregate(values, start, step)


def fnv_bucket(halves: Column, dim: int) -> Column:
    """The unsigned hash modulo ``dim``."""
    return ((halves["hi"] % dim) * (_WORD % dim) + halves["lo"]) % dim


def fnv_sign(halves: Column) -> Column:
    """1 if the top bit is set, else -1."""
    return F.when(halves["hi"] >= (1 << 31), F.lit(1)).otherwise(F.lit(-1))
