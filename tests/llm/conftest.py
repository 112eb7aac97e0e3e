import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _i long, row string, sig long, id long, data string, run int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names clash with the operators' own."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None, None, len(t or ""), 7, "x", 1, 2, "d", 3) for i, t in zip(ids, texts, strict=True)]
        path = make.folder.mktemp("docs") / "d.parquet"
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(path))
        return spark.read.parquet(str(path))

    return make


@pytest.fixture(scope="session", autouse=True)
def _folder(frame, tmp_path_factory):
    frame.folder = tmp_path_factory
