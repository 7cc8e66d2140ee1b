from test_ngram_join import brute
from test_tokens import check_packed, ids

__all__ = ["brute", "check_packed", "ids"]
