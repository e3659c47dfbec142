import zipfile

import numpy as np
import pytest

from tabulon.sources import tables, tensors


def put(folder, name, text):
    p = folder / name
    p.write_bytes(text.encode())
    return str(p)


def test_quoted_cells(spark, tmp_path):
    """Separators, doubled quotes and line breaks inside quotes; short, long and blank lines."""
    text = 'name,"said, to whom",n\r\n"Ana ""la"" Ruiz","one\ntwo, three",7\r\n\r\nBo,,NaN\r\nCy,x,8,extra\r\nDi\r\n" padded ",nan ,""\r\n'
    d = tables.read_csv(spark, put(tmp_path, "quoted.csv", text))
    assert d.columns == ["name", "said, to whom", "n"]
    assert [tuple(r) for r in d.collect()] == [('Ana "la" Ruiz', "one\ntwo, three", "7"), ("Bo", "", ""), ("Cy", "x", "8"), ("Di", "", ""), (" padded ", "nan ", "")]


@pytest.mark.parametrize(
    "text, columns, rows",
    [
        ("-0.25,1e9,inf\n8,NA,9\n", ["col_0", "col_1", "col_2"], [("-0.25", "1e9", "inf"), ("8", "", "9")]),
        ("3,,5\n6,7,8\n", ["3", "", "5"], [("6", "7", "8")]),
        (" 12 , 13\n1,2\n", ["col_0", "col_1"], [(" 12 ", " 13"), ("1", "2")]),
        ("0x10,2\n1,2\n", ["0x10", "2"], [("1", "2")]),
        ("only\n", ["only"], []),
        ("", [], []),
    ],
)
def test_first_record_names_or_is_data(spark, tmp_path, text, columns, rows):
    d = tables.read_csv(spark, put(tmp_path, "h.csv", text))
    assert d.columns == columns and [tuple(r) for r in d.collect()] == rows


def test_long_first_record(spark, tmp_path):
    names = [f"column number {k} with a long name" for k in range(3000)]
    d = tables.read_csv(spark, put(tmp_path, "wide.csv", ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n"))
    assert d.columns == names and d.count() == 1


def test_arff(spark, tmp_path):
    text = "% note\n@relation r\n@attribute 'a b' numeric\n@attribute c {x, 'y, z'}\n@data\n1.5,x\n?,'y, z'\n"
    d = tables.read_arff(spark, put(tmp_path, "a.arff", text))
    assert d.columns == ["a b", "c"] and [tuple(r) for r in d.collect()] == [(1.5, "x"), (None, "y, z")]
    assert d.schema["c"].metadata["values"] == ["x", "y, z"]
    assert tables.split_quoted("a, 'b, c' ,d") == ["a", "b, c", "d"]


def test_folder_and_archive(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    put(d, "H1__meas.csv", 'a,b\n1,"x\nw"\n')
    put(d, "H3__meas.csv", "a,b\n3,NA\n")
    put(d, "H2__meas.csv", "a,c\n2,y\n")
    put(d, "H4__meas.tsv", "a\tb\n4\tv, u\n")
    put(d, "other.csv", "q\nz\n")
    put(d, "H1.ann.txt", "5,6\n")
    put(d, "empty.csv", "")
    want = [("H1", "1", "x\nw", ""), ("H2", "2", "", "y"), ("H3", "3", "", ""), ("H4", "4", "v, u", "")]
    z = tmp_path / "d.zip"
    with zipfile.ZipFile(z, "w") as f:
        for p in d.iterdir():
            f.write(p, f"deep/{p.name}")
    for source in (d, z):
        got = tables.load(spark, str(source))
        assert set(got) == {"meas", "other", "H1.ann"}
        assert sorted(tuple(r) for r in got["meas"].select("_hash", "a", "b", "c").collect()) == want
        assert [tuple(r) for r in got["H1.ann"].collect()] == [("5", "6", "H1.ann")]
    assert list(tmp_path.iterdir()) in ([d, z], [z, d])  # nothing is unpacked
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../evil.csv", "a\n")
    with pytest.raises(Exception, match="unsafe path"):
        tables.load(spark, str(z))


def test_images(spark, tmp_path):
    """PNG files of two sizes, written here byte by byte, and a file that is none."""
    import struct
    import zlib

    def png(path, pixels):
        h, w, _ = pixels.shape
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    for label in ("3", "7"):
        (tmp_path / label).mkdir()
    first = np.arange(2 * 3 * 3).reshape(2, 3, 3) * 10
    png(tmp_path / "3" / "a.png", first)
    png(tmp_path / "7" / "b.png", np.repeat(np.repeat(first, 2, axis=0), 2, axis=1))
    (tmp_path / "7" / "c.png").write_bytes(b"no image")
    got = {r["stem"]: r for r in tensors.read_images(spark, str(tmp_path), labelled=True).collect()}
    assert {k: r["label"] for k, r in got.items()} == {"a": 3.0, "b": 7.0, "c": 7.0}
    assert got["c"]["pixels"] is None and got["a"]["width"] == got["b"]["width"] == 3 and got["a"]["channels"] == 3
    assert np.allclose(got["a"]["pixels"], first.ravel() / 255) and np.allclose(got["b"]["pixels"], first.ravel() / 255)


def test_tensors(spark, tmp_path):
    p = tmp_path / "t.safetensors"
    p.write_bytes(tensors.dump_tensors({"u": np.array([[0.5, -2], [7, 4.25]]), "w": np.array([1e6, -3])}))
    d = tensors.read_tensors(spark, str(p))
    assert d.columns == ["u:0", "u:1", "w"] and [tuple(r) for r in d.collect()] == [(0.5, -2, 1e6), (7, 4.25, -3)]
    with pytest.raises(ValueError):
        tensors.parse_header(b"\xff" * 16)


def test_node_text():
    n = tensors.Node.parse("model\n\tlr = 0.5\n\tlayer = dense\n\t\tsize = 3\nnote = a = b\n")
    assert n.number("model.lr") == 0.5 and n.get("model.layer.size").value == "3" and n.get("note").value == "a = b" and n.get("nope") is None
    assert tensors.Node.parse(n.dump()).dump() == n.dump()


def test_csv_folder_whose_first_part_is_empty(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("")
    (tmp_path / "part-1.csv").write_text("1,2\n3,4\n")
    got = tables.read_csv(spark, str(tmp_path), multiline=False)
    assert got.columns == ["col_0", "col_1"] and sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4")]
