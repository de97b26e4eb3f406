import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(folder / "shared"))
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Texts that every operator on documents must stand: null, empty, blank, one word, repeats, long, odd white space, marks.
ODD_TEXTS = [
    None, "", " ", "\n\t ", "a", "The cat sat.", "The cat sat.", "  two  spaces\n\nand  lines \n", "x" * 5000, "word " * 3000,
    "Ünïcödé straße ÇA éàü", "emoji \U0001f600 and 中文 text", "tab\tsep\r\nline\x0b\x0c end", "nbsp here em　wide\u0085nel",
    "don't we'll I'M <|endoftext|> <|startoftext|>x", "́start é", "123 4567.89 %%% $$$", "nul\x00byte \x1c sep",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", len(t or ""), "clash", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "again", "en", "src1", 5, "clash", 0), (3, "again", "en", "src1", 5, "clash", 0), (None, "no id", "en", "src1", 5, "clash", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, part long")
