"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage. Beside Spark it needs numpy, pandas,
pyarrow, pyahocorasick, xxhash, tokenizers and sentencepiece, and the tokenizer files whose
path is a parameter.
"""
