from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixed_vectors import BARE, EMPTY, MINIMAL, SINGLE
from titleloom.plans.encode import compress
from titleloom.sources import containers, documents, file_lists
from titleloom.sources.listing import document_names
from titleloom.sources.payload import decode_text, decompress

MARKER = "example.com/list#"


def page(payload):
    return f'<html><iframe src="https://{MARKER}{payload}"></iframe></html>'


def test_known_payloads():
    assert decode_text(EMPTY) == ('{"list":[]}', None)
    assert '"filename":"test.mkv"' in decode_text(MINIMAL)[0]
    assert '"size":1468614656' in decode_text(SINGLE)[0]
    assert decode_text(BARE)[0].startswith('[{"filename":"Shared.Movie.2024.mkv"')
    assert compress('{"list":[]}') == EMPTY
    for broken in ("not-valid-lz-data!!!", "", None, SINGLE[:40], "ééé", "日本"):
        assert decode_text(broken)[1] is not None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_payload_round_trip(text):
    assert decode_text(compress(text))[0] == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ABCDabcd0123+-$ ", max_size=80))
def test_any_payload_ends(text):
    decompress(text)


def test_lone_surrogate_is_an_error():
    assert decode_text(compress("\ud800x"))[1] == "payload is not valid UTF-16"


def test_listing(spark):
    rows = [
        ("index.html", "blob"),
        ("abc.html", "blob"),
        ("readme.md", "blob"),
        ("subdir", "tree"),
        ("sub/index.html", "blob"),
        ("x.html", "tree"),
    ]
    df = spark.createDataFrame(rows, "path string, type string")
    assert sorted(r.name for r in document_names(df).collect()) == ["abc.html", "sub/index.html"]


def test_fragment(spark):
    rows = [
        (page("abc"), "abc"),
        (page(""), ""),
        ("<html>none</html>", None),
        (f"x {MARKER}never closed", None),
        (f'é🎬 {MARKER}one" {MARKER}two"', "one"),
        (None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "html string")
    got = [r[0] for r in df.select(documents.fragment(F.col("html"), MARKER)).collect()]
    assert got == [r[1] for r in rows]


def entries(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    out = documents.with_entries(df)
    return [(r.title, r.entries and [tuple(e) for e in r.entries], r.entries is None) for r in out.orderBy("i").collect()]


E1 = '{"filename":"f","hash":"h","size":1}'


def test_document_shapes(spark):
    good = {
        '{"list":[%s]}' % E1: (None, [("f", "h", 1)]),
        '{"title":"T","torrents":[{"filename":"f","hash":"h","bytes":42,"more":[1]}]}': ("T", [("f", "h", 42)]),
        ' \n[%s,{"filename":"b","hash":"d","bytes":200}]' % E1: (None, [("f", "h", 1), ("b", "d", 200)]),
        '{"title":null,"list":[]}': (None, []),
        "[]": (None, []),
        '{"list":[%s],"extra":{"a":1}}' % E1: (None, [("f", "h", 1)]),
        r'{"list":[{"filename":"\ud83c\udfac \\ud800","hash":"h","size":1}]}': (None, [("🎬 \\ud800", "h", 1)]),
        '{"list":[{"filename":"f","hash":"h","size":9223372036854775807}]}': (None, [("f", "h", 2**63 - 1)]),
    }
    for (title, rows), got in zip(good.values(), entries(spark, list(good))):
        assert got == (title, rows if rows else got[1], False)
        assert (got[1] or []) == rows


def test_broken_documents_fail_as_a_whole(spark):
    bad = [
        '{"title":"oops"}',
        '{"list":[%s,{"filename":"f","hash":"h"}]}' % E1,
        '{"list":[%s,{"filename":1,"hash":"h","size":1}]}' % E1,
        '{"list":[{"filename":"f","hash":"h","size":-1}]}',
        '{"list":[{"filename":"f","hash":"h","size":1.5}]}',
        '{"list":[{"filename":"f","hash":"h","size":"1"}]}',
        '{"list":[{"filename":"f","hash":"h","size":18446744073709551615}]}',
        '{"list":[{"filename":null,"hash":"h","size":1}]}',
        '{"list":[{"filename":"f","hash":"h","size":1,"bytes":1}]}',
        '{"list":[{"filename":"f","hash":"h","size":1,"size":2}]}',
        '{"list":[],"torrents":[]}',
        '{"list":{}}',
        '{"list":[5]}',
        '{"title":5,"list":[]}',
        "[%s] x" % E1,
        "[%s]]" % E1,
        '{"list":[]},"more":{"a":1',
        '{"list":[]},"more":1',
        "[%s" % E1,
        "[%s],7" % E1,
        '{"list":[]},{"list":[]}',
        '{"list":[],"x":NaN}',
        "{'list':[]}",
        '{"list":[{"filename":"\\ud800","hash":"h","size":1}]}',
        '{"list":[{"filename":"\\udfac","hash":"h","size":1}]}',
        "null",
        "nonsense",
        '"text"',
        "",
        None,
    ]
    assert [g[2] for g in entries(spark, bad)] == [True] * len(bad)


def test_documents_of_any_size(spark):
    """A string of 40 MB, and a document of 60 MB in many short entries, are valid."""
    long = "x" * (40 << 20)
    many = ",".join(['{"filename":"%s","hash":"h","size":1}' % ("f" * 100)] * 400_000)
    df = spark.createDataFrame([(0, '[{"filename":"%s","hash":"h","size":1}]' % long), (1, f'{{"list":[{many}]}}')], "i int, json string")
    got = documents.with_entries(df).selectExpr("i", "size(entries) AS n", "length(entries[0].filename) AS m").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 40 << 20), (1, 400_000, 100)]


def test_documents_end_to_end(spark):
    rows = [
        ("one", page(SINGLE)),
        ("none", page(EMPTY)),
        ("bad", page("!!")),
        ("no", "<html></html>"),
        ("odd", page(compress('{"title":"x"}'))),
        ("two", page(compress('{"title":"T","torrents":[{"filename":"é","hash":"h","bytes":5},%s]}' % E1))),
    ]
    read = documents.read_documents(
        spark.createDataFrame(rows, "source string, html string"), MARKER
    )
    items = sorted(tuple(r) for r in documents.document_items(read).collect())
    assert items == [
        ("one", None, 0, "Big.Buck.Bunny.2008.1080p.BluRay.x264", "dd8255ecdc7ca55fb0bbf81323d87062db1f6d1c", 1468614656),
        ("two", "T", 0, "é", "h", 5),
        ("two", "T", 1, "f", "h", 1),
    ]
    assert sorted(r.source for r in documents.document_errors(read).collect()) == ["bad", "no", "odd"]


THREE = (
    b"d4:infod5:filesld6:lengthi500000000e4:pathl10:S01E01.mkveed6:lengthi480000000e4:pathl10:S01E02.mkveed"
    b"6:lengthi1000e4:pathl8:info.nfoeee4:name11:My Season 1ee"
)


def files(spark, contents, wrapped=True):
    df = spark.createDataFrame(
        [(str(i), c) for i, c in enumerate(contents)], "key string, content binary"
    )
    out = containers.container_files(df, wrapped).collect()
    return {
        str(i): sorted(
            ((r.path, r.size, r.file_index) for r in out if r.key == str(i) and r.error is None),
            key=lambda r: r[2],
        )
        or ("error" if any(r.key == str(i) for r in out) else "empty")
        for i in range(len(contents))
    }


def test_wrapped_containers(spark):
    got = files(
        spark,
        [
            b"d4:infod4:name9:movie.mkv6:lengthi1073741824eee",
            THREE,
            b"not valid bencode",
            b"d7:commenti42ee",
            b"d4:infod5:filesleee",
            # a number, an entry without a path and one with bad text keep their positions
            b"d4:infod5:filesli7ed6:lengthi1eed4:pathl1:\xff1:aeed4:pathl1:beeeee",
            b"d4:infod5:filesi1eee",
            b"",
            b"d4:infod4:name1:ae",
            b"l" * 5000,
            # an unused list of any depth does no harm
            b"d4:infod4:name1:a6:lengthi5ee4:more" + b"l" * 3000 + b"e" * 3001,
            b"d4:infod4:name1:a6:lengthi1_0eee",
            b"d4:infod4:name1:a6:lengthi +7 eee",
            b"d4:infod4:name1:a6:lengthi-0eee",
            b"d4:infod4:name\xd9\xa1:a6:lengthi1eee",
        ],
    )
    assert got["0"] == [("movie.mkv", 1073741824, 0)]
    assert [f[0] for f in got["1"]] == ["S01E01.mkv", "S01E02.mkv", "info.nfo"]
    assert [f[2] for f in got["1"]] == [0, 1, 2]
    assert got["5"] == [("a", 0, 2), ("b", 0, 3)]
    assert got["4"] == "empty"
    assert all(got[k] == "error" for k in "236789")
    assert got["10"] == [("a", 5, 0)]
    assert got["11"] == got["12"] == got["14"] == "error"
    assert got["13"] == [("a", 0, 0)]


def test_bare_containers(spark):
    got = files(
        spark,
        [
            b"d5:filesld6:lengthi500e4:pathl8:Season 110:S01E01.mkveee4:name7:My Showe",
            b"l3:fooe",
            b"d6:lengthi100ee",
        ],
        wrapped=False,
    )
    assert got == {"0": [("Season 1/S01E01.mkv", 500, 0)], "1": "error", "2": "error"}


def test_json_file_lists(spark):
    rows = [
        ("a", '{"files":[{"id":1,"path":"/d/x.mkv","bytes":5},{"id":0,"path":"y","bytes":6},{"id":3,"path":"//z","bytes":7}]}'),
        ("b", '{"files":[{"id":"1","path":"x","bytes":5},{"path":"x","bytes":5},{"id":2,"path":3,"bytes":5},{"id":2,"path":"k","bytes":-1},7]}'),
        ("c", '{"nothing":1}'),
        ("d", "broken"),
    ]
    listed = file_lists.with_files(spark.createDataFrame(rows, "key string, json string"))
    got = sorted(tuple(r) for r in file_lists.file_rows(listed).collect())
    assert got == [("a", "/z", 7, 2, 2), ("a", "d/x.mkv", 5, 0, 0), ("a", "y", 6, 0, 1)]
    assert sorted(r.key for r in file_lists.list_errors(listed).collect()) == ["c", "d"]


def _bencode(value):
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return b"%d:%s" % (len(raw), raw)
    if isinstance(value, dict):
        return b"d" + b"".join(_bencode(k) + _bencode(v) for k, v in value.items()) + b"e"
    return b"l" + b"".join(map(_bencode, value)) + b"e"


def _slow_files(content, wrapped):
    """What the whole value says, built at once."""
    top, _ = containers._parse(content)
    info = top.get(b"info") if wrapped and isinstance(top, dict) else top
    if not isinstance(info, dict):
        raise ValueError
    if b"files" not in info:
        name, size = info.get(b"name"), info.get(b"length")
        if containers._text(name) is None or not isinstance(size, int):
            raise ValueError
        return [(name.decode(), size, 0)]
    if not isinstance(info[b"files"], list):
        raise ValueError
    out = []
    for i, e in enumerate(info[b"files"]):
        if isinstance(e, dict):
            parts = [containers._text(p) for p in e[b"path"]] if isinstance(e.get(b"path"), list) else []
            path = "/".join(p for p in parts if p is not None)
            if path:
                out.append((path, e[b"length"] if isinstance(e.get(b"length"), int) else 0, i))
    return out


_LEAF = st.one_of(st.integers(-5, 2**63), st.sampled_from(["files", "info", "name", "length", "path", "x", b"\xff"]))
_KEYS = st.sampled_from(["info", "files", "name", "length", "path", "other"])
_VALUE = st.recursive(_LEAF, lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(_KEYS, inner, max_size=4)), max_leaves=25)


@settings(max_examples=400, deadline=None)
@given(_VALUE, _KEYS, _VALUE, st.binary(max_size=3), st.integers(0, 60))
def test_containers_read_step_by_step_as_at_once(value, key, more, tail, cut):
    # A dictionary with a key twice, a broken end, bytes behind the value.
    data = b"d" + _bencode(key) + _bencode(more) + _bencode("info") + _bencode(value) + _bencode(key) + _bencode(value) + b"e" + tail
    for content in (data, data[:cut], _bencode(value), _bencode({"info": {"files": [{"path": ["a", key], "length": 3}, value]}})):
        for wrapped in (True, False):
            results = []
            for read in (lambda: list(containers._files(content, wrapped)), lambda: _slow_files(content, wrapped)):
                try:
                    results.append(read())
                except ValueError:
                    results.append("broken")
            assert results[0] == results[1]


def test_a_container_of_many_files_needs_little_memory():
    import tracemalloc

    entry = _bencode({"length": 7, "path": ["folder", "a name of a file.mkv"]})
    content = b"d4:infod5:filesl" + entry * 20_000 + b"eee"
    tracemalloc.start()
    assert sum(size for _, size, _ in containers._files(content, True)) == 140_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 17


def test_polled_listing(spark, tmp_path):
    """Manifests of several row groups, polls between batches, a restart."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from titleloom.sources import polled

    folder = str(tmp_path / "polls")
    (tmp_path / "polls").mkdir()
    put = lambda name, paths: pq.write_table(pa.table({"type": ["blob"] * len(paths), "path": paths, "more": paths}), f"{folder}/{name}.parquet", row_group_size=2)
    polled.register(spark)
    load = lambda: spark.read.format(polled.NAME).load(folder)
    assert load().collect() == []
    put("2024-05-01", ["a", "b", "c", "d", "e"])
    assert sorted(r.path for r in load().collect()) == list("abcde") and load().rdd.getNumPartitions() == 3

    def run():
        stream = spark.readStream.format(polled.NAME).option("per_batch", 1).load(folder)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.path for r in spark.read.schema("path string, type string").parquet(str(tmp_path / "out")).collect())

    assert run() == list("abcde")
    put("2024-05-02", ["f"])
    put("2024-05-03", ["g", "a"])
    assert run() == sorted("abcdefga")
    assert run() == sorted("abcdefga")
