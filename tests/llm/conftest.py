import pytest

#: Texts that stress every operator: null, empty, blank, one word, odd spaces, marks, controls, long runs.
ODD_TEXTS = [
    None, "", " ", "\n\t \x0b\x0c\r", "one", "One two", "one two three four", "a  b   c\n \nd \te ",
    "É être — ‘quoted’ ΣΑΣ İstanbul ǅ  nbsp em 　ideographic", "null\x00byte \x1c\x1f controls \x85 next",
    "don't I'll we've 'S it's", "é combining ñ", "日本語 テキスト 한국어 ไทย 🙂🙃", "x" * 5000, "ab " * 4000,
    "<|endoftext|> inside <|startoftext|>text <|endoftext|>", "12345 6.7e8 ½ ² Ⅷ", "=== *** !!! ... <<>>", "tail space ", " lead",
]


@pytest.fixture
def documents(spark):
    def make(texts, sources=None, ids=None, extra=None):
        ids = ids if ids is not None else list(range(len(texts)))
        rows = [(i, t, "en", sources[k] if sources else "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F
            for name in extra:
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make


#: Column names that operators use themselves.
CLASHES = ("row", "id", "fp", "key", "component_id", "group", "size", "taken", "piece", "tier", "labels", "score", "n_tokens",
           "kept", "h", "x", "doc", "tag", "at", "kind", "data", "word", "what", "_row", "document", "node", "root")
