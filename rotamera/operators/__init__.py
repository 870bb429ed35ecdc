"""DataFrame-in, DataFrame-out operators. All take ``keys``, the columns naming an ensemble."""

KEYS = ["ensemble_id"]
