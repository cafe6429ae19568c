"""Training-data operators: quality, sharding, decontamination, deduplication, secrets, chat, toxicity, packing.

Nothing outside this folder imports it; it can be deleted as a whole.
"""
