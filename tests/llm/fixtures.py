"""Small documents with every awkward case, and the library's own tokenizer."""

import random

import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Columns that clash with the operators' own names.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "kept boolean, Key string, `n words` int, spans string, target double"
)


def sentence(seed: int, words: int) -> str:
    draw = random.Random(seed)
    stems = ["ra", "to", "mi", "len", "or", "ta", "shi", "ven", "über", "çon", "el", "n"]
    return " ".join("".join(draw.choices(stems, k=draw.randint(1, 4))) for _ in range(words))


def odd_texts() -> list:
    long = sentence(1, 30_000)
    return [
        None,
        "",
        " \n\t ",
        "One",
        "one ",
        "Two words",
        sentence(2, 40),
        sentence(2, 40),
        sentence(2, 40) + " more",
        sentence(3, 12).upper(),
        "a b a b a b a b a b a b a b",
        "line\nline\n\nline\n other \n",
        "### $$$ %%% & <b>|</b> *",
        "İstanbul ΣΑΣ ﬁne éà ẛ̣ ½ ² Ⅷ 東京 ไทย \x1c\x1d x\x1fy z　w",
        "it's we'll I'D '' don't''s <|endoftext|> a<|startoftext|>b <|END",
        "퟿ \U0001f600‍\U0001f468 ́ á",
        long,
        "x" * 5000,
    ]


def odd_documents(spark):
    rows = [
        (i, text, "en", f"s{i % 3}" if i % 4 else None, None if text is None else len(text), None, "k", 1, "s", 0.5)
        for i, text in enumerate(odd_texts())
    ]
    rows.append(rows[6])
    rows.append((None, sentence(4, 30), None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=lambda r: [(v is None, str(v)) for v in r])
