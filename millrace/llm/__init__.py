"""Operators for preparing training data: licences, tokenizing, language, duplicates, quality,
decontamination, sharding, token counts and toxicity."""
