"""Random masking for pre-training, of token rows or of whole encoded rows."""

from pyspark.sql import Column, DataFrame, functions as F

from visitseq.constants import (
    IGNORED_LABEL, MASK, MASK_BELOW, PAD, RANDOM_BELOW, SELECT_SHARE)
from visitseq.functions.arrays import pad
from visitseq.functions.keyed import below, draw_hex, uniform
from visitseq.operators.indexing import with_row_index
from visitseq.operators.lookup import join_vocab
from visitseq.operators.vocab import VocabFacts, vocab_facts


def _big(value) -> Column:
    return F.lit(value).cast("bigint")


def _output(token_id: Column, drawn: Column, random_id: Column, facts: VocabFacts,
            drop_kept: bool) -> Column:
    """What the model reads. The random id stands in a branch, so that the second
    draw is only made for the few tokens that need it."""
    kept = _big(None) if drop_kept else token_id
    return (F.when(below(drawn, MASK_BELOW), _big(facts.ids[MASK]))
            .when(below(drawn, RANDOM_BELOW), random_id)
            .when(below(drawn, SELECT_SHARE), kept)
            .otherwise(token_id))


def _label(token_id: Column, drawn: Column) -> Column:
    return F.when(below(drawn, SELECT_SHARE), token_id).otherwise(_big(IGNORED_LABEL))


def _random_rank(key, epoch: int, seed: int, facts: VocabFacts) -> Column:
    """Which id, counted from 0 in rising order, stands in for a token."""
    return F.floor(uniform(*key, epoch, seed, draw=1) * facts.size).cast("bigint")


def _id_at(rows: DataFrame, vocab: DataFrame, facts: VocabFacts) -> DataFrame:
    """Adds `_random`, the vocabulary's id at `_rank` (null where that is null)."""
    ranked = with_row_index(vocab.select(F.col("token_id").cast("bigint").alias("_random")),
                            ["_random"], "_rank")
    return join_vocab(rows, ranked, ["_rank"], facts)


def random_mask(tokens: DataFrame, vocab: DataFrame, key=("patid", "pos"), epoch: int = 0,
                seed: int = 0, drop_kept: bool = False, facts: VocabFacts | None = None
                ) -> DataFrame:
    """Adds `output_id` and `label` to rows with a `token_id`.

    The draws are keyed by row and epoch: the same epoch always masks the same
    tokens, another epoch masks others. A random id is one of the vocabulary's; where its ids
    are 0 .. n-1 it needs no lookup. A selected token that is kept stays in
    the output; with drop_kept its output is null, for readers of tables where
    such tokens were left out.
    """
    facts = facts or vocab_facts(vocab)
    keys = [F.col(k) for k in key]
    drawn = tokens.withColumn("_draw", draw_hex(*keys, epoch, seed))
    rank = _random_rank(keys, epoch, seed, facts)
    if facts.dense:
        random_id = rank
    else:
        needed = ~below(F.col("_draw"), MASK_BELOW) & below(F.col("_draw"), RANDOM_BELOW)
        drawn = _id_at(drawn.withColumn("_rank", F.when(needed, rank)), vocab, facts)
        random_id = F.col("_random")
    output = _output(F.col("token_id"), F.col("_draw"), random_id, facts, drop_kept)
    return drawn.withColumns({
        "output_id": output, "label": _label(F.col("token_id"), F.col("_draw"))}).drop(
            "_draw", "_rank", "_random")


def mask_rows(encoded: DataFrame, vocab: DataFrame, max_len: int, epoch: int = 0,
              seed: int = 0, drop_kept: bool = False, key=("patid",)) -> DataFrame:
    """Masks the `code` arrays of encoded rows and adds their `label` arrays.

    The draws are those of `random_mask`. Row-local where the vocabulary's ids are 0 .. n-1: an
    encoded table is stored once and every epoch is a map over it. Other ids are looked up by
    token row and put together again by `key`.
    """
    facts = vocab_facts(vocab)
    keys = [F.col(k) for k in key]
    real = F.slice("code", 1, F.size(F.array_remove("mask", _big(0))))
    if facts.dense:
        drawn = encoded.withColumn("_drawn", F.transform(real, lambda t, i: F.struct(
            t.alias("id"), i.alias("pos"), draw_hex(*keys, i, epoch, seed).alias("draw"))))
        outputs = F.transform("_drawn", lambda x: _output(
            x["id"], x["draw"], _random_rank([*keys, x["pos"]], epoch, seed, facts), facts,
            drop_kept))
        labels = F.transform("_drawn", lambda x: _label(x["id"], x["draw"]))
    else:
        tokens = encoded.select(*key, F.posexplode(real).alias("pos", "token_id"))
        masked = random_mask(tokens, vocab, (*key, "pos"), epoch, seed, drop_kept)
        lists = masked.groupBy(*key).agg(F.sort_array(F.collect_list(
            F.struct("pos", "output_id", "label"))).alias("_drawn"))
        drawn = encoded.join(lists, list(key))
        outputs, labels = F.col("_drawn.output_id"), F.col("_drawn.label")
    if drop_kept:
        outputs = F.filter(outputs, lambda x: x.isNotNull())
    return drawn.withColumns({
        "code": pad(outputs, max_len, _big(facts.ids[PAD])),
        "label": pad(labels, max_len, _big(IGNORED_LABEL))}).drop("_drawn")
