"""Training-data operators (near-dedup, quality rules, packing, licence scans, embedding dedup, LM scoring,
language ID, line dedup, SentencePiece transducer, token counts). Nothing outside this folder and
``corpus_pipeline.py`` imports it."""
