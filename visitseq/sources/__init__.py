from visitseq.sources.readers import (
    read_batch, read_csv, read_epoch, read_parquet, read_tsv, read_vocab)
from visitseq.sources.scratch import (
    drop_table, materialize, materialize_by, recording, scratch_path)
from visitseq.sources.writers import append_log, write_epoch, write_parquet, write_tsv, write_vocab

__all__ = [
    "append_log", "drop_table", "materialize", "materialize_by", "read_batch", "read_csv",
    "read_epoch", "read_parquet", "read_tsv", "read_vocab", "recording", "scratch_path",
    "write_epoch", "write_parquet", "write_tsv", "write_vocab",
]
