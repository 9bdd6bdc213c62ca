"""Training-data operators: dedup, decontamination, classifiers, token counts, mixing and chat formatting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; ``queries.py`` holds the registered queries.
"""
