"""Operators of a training-data pipeline: extraction, token counting, similarity joins,
decontamination, language identification, deduplication, chat formatting, BPE, WARC, prefix tries of
conversations, packing, phrase collocations.

Nothing else in the library imports this subpackage.
"""
