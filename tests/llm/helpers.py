import random

WORDS = [a + b for a in ("ta", "ri", "mo", "ke", "su", "ble") for b in ("n", "lo", "ve", "st", "qua", "")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None, partitions=3):
    """documents with columns whose names operators also use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, None, None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOCS).repartition(partitions)
    for name in ("fp", "key", "runs", "run_of", "tag", "s", "b", "bucket", "rest", "loser", "ids", "marks", "h", "label"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def odd_texts():
    """Nulls, empty, blank, odd white space, ties and copies, other scripts, very long ones."""
    rng = random.Random(5)
    base = prose(rng, 120)
    return [
        None, "", " ", "\n\t \r", base, base, base, base[:200] + "X" + base[201:], base.upper(), "a", "aaaa", "a" * 70_000, "ab " * 20_000,
        "日本語のテキスト" * 30, "é" * 100, "<|endoftext|> <s> </s>", "x\x00y\x1c\x85z", prose(rng, 30), prose(rng, 5000), "word", "two words", "three little words", "😀😀 😀",
    ]
