from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import tokens
from caselens.llm.registry import query, table

#: Tokenizer of the token queries: a file of the public tokenizers package, its number of ids and the end id.
TOKENIZER, VOCABULARY, END_ID = "byte_bpe_50k.json", 50_257, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.read(spark, tokens.tokenize(docs, tokenizer_path(), end_id=END_ID, vocabulary=VOCABULARY))
