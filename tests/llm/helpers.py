"""Small document tables with every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat sat on a mat and then it ran off to see what was there with no one near".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + ("" if x % 5 else str(x % 97)))
    return " ".join(out)


def rows() -> list[tuple]:
    texts = [prose(k, 40 + 7 * k) for k in range(12)]
    texts += [None, "", " \n\t ", "one", "two words", texts[0], texts[0], texts[1] + " extra", texts[2].replace("cat", "dog", 1)]
    texts += ["a" * 400, "ab" * 300, "é" * 150 + texts[3], "日本語のテキスト " * 30, prose(99, 4000)]
    found = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return [*found, (None, texts[5], None, None, None), (3, texts[3], "en", "s0", 9), (3, texts[3], "en", "s0", 9)]


def table(spark, data=None, extra: tuple[str, ...] = ()):
    df = spark.createDataFrame(rows() if data is None else data, DOCS).repartition(3)
    from pyspark.sql import functions as F

    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


def folder(spark, tmp_path, docs, **tables) -> str:
    """A folder like the driver's, with ``documents`` and whatever else is given."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
