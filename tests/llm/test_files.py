"""Archives and token stores lie in the file system that Spark gives their folder."""

from __future__ import annotations

import os

import public_tokenizers
import pytest
from pyarrow import fs

from sessionscope.llm import files, tokenstore, warc


@pytest.fixture
def default_file_system(spark):
    """Paths without a scheme get another meaning: a mount table over a folder of the test."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    yield conf
    conf.set("fs.defaultFS", before)


def test_schemes(spark, tmp_path):
    plain = str(tmp_path / "a b")
    assert files.located(spark, plain) == f"file:{plain}"
    for path in (f"file:{plain}/x", f"file://{plain}/x"):
        with files.open_output(path) as out:
            out.write(b"here")
        with files.open_input(path) as source:
            assert source.read() == b"here"
    assert (tmp_path / "a b" / "x").read_bytes() == b"here"
    with pytest.raises(ValueError, match="no scheme"):
        files.open_output(f"{plain}/x")


def test_names_of_s3(monkeypatch):
    asked = []
    monkeypatch.setattr(files.fs, "FileSystem", type("Known", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, ""))}))
    for path in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x", "hdfs://host:9000/x"):
        files._located(path)
    assert asked == ["s3://bucket/x", "s3://bucket/x", "s3://bucket/x", "hdfs://host:9000/x"]


def test_paths_without_a_scheme_follow_the_default(spark, tmp_path, default_file_system):
    default_file_system.set("fs.viewfs.mounttable.shared.link./archive", f"file:{tmp_path}")
    default_file_system.set("fs.defaultFS", "viewfs://shared/")
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    # Not the local disk; without Hadoop's client library Arrow cannot open mount tables: refused before anything is written.
    with pytest.raises(ValueError, match="viewfs"):
        warc.archive_pages(pages, "/archive")
    assert not os.path.exists("/archive") and not os.listdir(tmp_path)


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_round_trips_by_every_form_of_a_path(spark, tmp_path, form):
    folder = form.format(tmp_path)
    pages = spark.createDataFrame([(1, "u", "é"), (2, "u", "é")], "page_id long, url string, html string")
    warc.archive_pages(pages, f"{folder}/archive")
    found = {r.page_id: r.refers_to for r in warc.read_records(spark, f"{folder}/archive").collect()}
    assert found == {1: 2, 2: None}
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    tokenstore.write_store(docs, f"{folder}/store", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    assert [r.doc_id for r in tokenstore.read_documents(spark, f"{folder}/store").orderBy("start").collect()] == [1, 2]
    assert isinstance(files._located(files.located(spark, folder))[0], fs.LocalFileSystem)
