"""Token ids by joining token rows with a vocabulary."""

from pyspark.sql import DataFrame, functions as F

from visitseq.constants import UNK
from visitseq.operators.vocab import VocabFacts, vocab_facts
from visitseq.sources.scratch import materialize

# A vocabulary is broadcast up to this measured size.
BROADCAST_BYTES = 64 << 20
# Overhead of a row in the broadcast hash table, beside the text of its token.
ROW_BYTES = 48
# A value with more than one in so many rows is joined apart; one row in so many is looked at.
HEAVY_SHARE = 1000
SAMPLED = 64


def fits_broadcast(n_rows: int, n_bytes: int = 0, most: int | None = None) -> bool:
    return n_bytes + n_rows * ROW_BYTES <= (BROADCAST_BYTES if most is None else most)


def heavy_values(tokens: DataFrame, on: list[str], row_key=None, share: int = HEAVY_SHARE
                 ) -> DataFrame:
    """The values of `on` that make up more than one in `share` of the rows, with their count `_n`:
    fewer than `share` rows.

    Candidates come from a sample, one row in SAMPLED by the hash of its key (the same in a
    retry), and are then counted exactly. What the sample misses is no wrong answer, only a
    value that is joined with the others.
    """
    drawn = F.pmod(F.xxhash64(*(row_key or tokens.columns), F.lit(1)), F.lit(SAMPLED)) == 0
    seen = tokens.where(drawn).groupBy(*on).agg(F.count("*").alias("_seen"))
    sampled = seen.agg(F.sum("_seen")).head()[0] or 0
    # half the share, as a sample may show less; more than 2 * share rows cannot have it
    likely = seen.where(F.col("_seen") * 2 * share > sampled).select(*on)
    n = tokens.count()
    return (tokens.join(F.broadcast(likely), on, "left_semi").groupBy(*on)
            .agg(F.count("*").alias("_n")).where(F.col("_n") * share > n))


def join_vocab(tokens: DataFrame, vocab: DataFrame, on: list[str], *facts: VocabFacts,
               broadcast_bytes: int | None = None, row_key=None) -> DataFrame:
    """Left join to a vocabulary whose size was measured.

    A small one is broadcast. Of a larger one only the entries of the heavy values are, of fewer
    than HEAVY_SHARE values and only if they fit; the other rows and the vocabulary are shuffled by token, each
    once. So no task gets more than about one in HEAVY_SHARE of the rows from one token, and no
    entry is copied. `row_key` are columns that tell rows apart, by default all of them.

    Beyond the broadcast size the tokens are written once, as they are read several times.
    """
    if fits_broadcast(sum(f.size for f in facts), sum(f.n_bytes for f in facts), broadcast_bytes):
        return tokens.join(F.broadcast(vocab), on, "left")
    stored = materialize(tokens, "tokens")
    heavy = materialize(heavy_values(stored, on, row_key).select(*on), "heavy")
    entries = materialize(heavy.join(vocab, on, "left"), "entries")
    few = F.broadcast(entries) if fits_broadcast(entries.count()) else entries
    light = stored.join(F.broadcast(heavy), on, "left_anti").join(
        vocab.hint("shuffle_merge"), on, "left")
    return stored.join(few, on).select(*light.columns).unionByName(light)


def encode_tokens(tokens: DataFrame, vocab: DataFrame, mask_token: str | None = None,
                  token_col: str = "token", id_col: str = "token_id",
                  unknown: bool = True, broadcast_bytes: int | None = None,
                  row_key=None) -> DataFrame:
    """Id per token row; an unknown token, or one equal to mask_token, becomes UNK
    (with unknown=False an unknown token becomes null)."""
    facts = vocab_facts(vocab, id_col)
    dim = vocab.select(F.col("token").alias(token_col), F.col(id_col))
    out = join_vocab(tokens, dim, [token_col], facts, broadcast_bytes=broadcast_bytes,
                     row_key=row_key)
    unk = F.lit(facts.ids[UNK])
    found = F.coalesce(F.col(id_col), unk) if unknown else F.col(id_col)
    if mask_token is not None:
        found = F.when(F.col(token_col) == mask_token, unk).otherwise(found)
    return out.withColumn(id_col, found.cast("bigint"))


def encode_labels(labels: DataFrame, label_vocab: DataFrame, **kwargs) -> DataFrame:
    return encode_tokens(labels, label_vocab, id_col="label_id", **kwargs)


def decode_tokens(ids: DataFrame, vocab: DataFrame, id_col: str = "token_id") -> DataFrame:
    """Token of each id."""
    dim = vocab.select(F.col("token_id").alias(id_col), "token")
    return join_vocab(ids, dim, [id_col], vocab_facts(vocab))
