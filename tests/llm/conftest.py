import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, n_ids long"


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    from freshet.llm import bytebpe

    return Tokenizer.from_file(bytebpe.default_path())


@pytest.fixture(scope="session")
def texts():
    """Empty and null, very long, repeated, special strings, spaces, many scripts."""
    prose = "The quick brown fox, it's 42 naïve déjà vu — übergroß ñandú 東京 🙂. "
    return [
        None,
        "",
        " ",
        "\n\n  \t x",
        "a",
        prose,
        prose,
        prose * 40,
        prose.replace(" ", "") * 900,
        "x" * 5000,
        " " * 4000 + "y" * 4000,
        "before<|endoftext|>after <|endoftext|> <|endoftext",
        "word " * 9000,
        "mail a.b+c@ex-ample.org, ip 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (386) 555-3733.",
        "I'll we've 'RE don't  x\u0085y",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """One row for each text, numbered; columns with clashing names; nulls in them."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def messy_rows(texts):
    """(id, text): every text, ids that repeat with another text and with the same one, null ids, alone and repeated."""
    rows = list(enumerate(texts))
    return rows + [(3, "another text of the same id"), (3, "another text of the same id"), (6, None), rows[5]] + [(None, t) for t in texts[:7]] + [(None, "x y z")] * 3


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """These rows, dealt anew, with columns that are named like the operators' own."""
    rows = [(i, t, "en", None if n % 4 == 0 else f"s{n % 2}", n, n + 1, n + 2, "x", 0) for n, (i, t) in enumerate(messy_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long, _id long, n_chars long, part string, `a.b` int").repartition(3)
