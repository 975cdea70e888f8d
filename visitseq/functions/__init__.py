from visitseq.functions.ages import age_id, age_in_months, age_in_years
from visitseq.functions.arrays import (
    add_cls, attention_mask, count_token, index_seg, pad, position_idx, tail)
from visitseq.functions.keyed import uniform

__all__ = [
    "add_cls", "age_id", "age_in_months", "age_in_years", "attention_mask",
    "count_token", "index_seg", "pad", "position_idx", "tail", "uniform",
]
