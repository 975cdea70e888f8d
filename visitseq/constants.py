"""The tokens, ids and defaults that the data format prescribes."""

PAD, UNK, SEP, CLS, MASK = "PAD", "UNK", "SEP", "CLS", "MASK"

# A new code vocabulary gives the specials the ids 0..4 in this order.
SPECIALS = (PAD, UNK, SEP, CLS, MASK)
# Specials that can never be a label.
NOT_LABELS = (PAD, SEP, CLS, MASK)

AGE_SYMBOLS = (PAD, UNK)
MAX_AGE = 110

IGNORED_LABEL = -1

MIN_VISITS = 5
MLM_MAX_LEN = 64
PREDICTION_MAX_LEN = 100
BATCH_SIZE = 256

# Masking: 15 % of the tokens are selected; of those 80 % become MASK,
# 10 % a random vocabulary id and 10 % stay as they are.
SELECT_SHARE = 0.15
MASK_BELOW = 0.12
RANDOM_BELOW = 0.135
