"""Training-data operators (deduplication, filtering, mixing, tokenising, search).

One module per operator, each with a general DataFrame interface; ``queries``
registers one query per operator. Nothing else in the package imports this one.
"""
