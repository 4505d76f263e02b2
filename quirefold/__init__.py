"""quirefold: a Spark-native engine for document corpora.

Everything outside ``quirefold.llm`` is the general engine; the training-data
operators live in ``quirefold.llm`` and nothing here imports them.
"""

__version__ = "0.1.0"
