"""JSON maps and heads of manifests, cut into blocks of any size."""

import json
import os
import random

import pytest

from vocalith.sources import io, maps, scratch

STRINGS = ["", "a b", 'say "x", "y": z', 'ends with \\', '\\" , "', "ä€😀", "line\nbreak", ", ", '": "', "{", "}", '{"k": "v"}', "\\\\", "w " * 400, '"', 'tail"']


def written(rng, n):
    return {f"{i}/{rng.choice(STRINGS)}": rng.choice([*STRINGS, None, 7, 1.5, True]) for i in range(n)}


@pytest.fixture
def block_bytes(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, n)
    spark.conf.set(key, before)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_maps(spark, tmp_path, block_bytes, size):
    rng = random.Random(size)
    want = []
    for k, how in enumerate([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}, {"separators": (" ,\n", " : ")}]):
        for n in (0, 1, 12):
            m = written(rng, n)
            (tmp_path / f"m{k}-{n}.json").write_text(json.dumps(m, **how) + "\n" * (k % 2))
            want += [(f"m{k}-{n}.json", a, b if b is None or isinstance(b, str) else json.dumps(b)) for a, b in m.items()]
    block_bytes(size)
    got = maps.read_maps(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((r.file.rsplit("/", 1)[1], r.key, r.value) for r in got))) == sorted(map(str, want))


def test_blocks_agree():
    """However a file is cut, its stretches are the same entries."""
    rng = random.Random(5)
    m = written(rng, 12)
    pieces = json.dumps(m).split('"')
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, len(pieces)), rng.randint(0, 6)))
        inside, rows, got = False, [], []
        for b, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(pieces)])):
            block = maps.Block(inside)
            for piece in pieces[x:y]:
                rows += [(b, *s) for s in block.feed(piece)]
                inside ^= maps.closed(piece)
            rows += [(b, *s) for s in block.end()]
        got = [maps.entry(t) for _, p, t in rows if p == maps.ENTRY]
        import pyarrow as pa

        loose = [r for r in rows if r[1] != maps.ENTRY]
        found = maps._stitched(pa.table({"file": ["f"] * len(loose), "block": [r[0] for r in loose], "place": [r[1] for r in loose], "raw": [r[2] for r in loose]}))
        got += list(zip(found.column("key").to_pylist(), found.column("value").to_pylist()))
        assert sorted(map(str, got)) == sorted(str((k, v if v is None or isinstance(v, str) else json.dumps(v))) for k, v in m.items())


@pytest.mark.parametrize("bad", ['{"a": "b"', '["a"]', "nope", '{"a": {"b": "c"}}', '{"a" "b"}'])
def test_bad_maps_fail(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text(bad)
    with pytest.raises(Exception):
        maps.read_maps(spark, str(tmp_path / "x.json")).collect()


def test_large_map(spark, tmp_path, block_bytes):
    """Half a million hypotheses in one file are read by many tasks."""
    with (tmp_path / "hyp__m__s.json").open("w") as f:
        f.write("{" + ", ".join(f'"/a/{i}.wav": "some words of {i}"' for i in range(500_000)) + "}")
    block_bytes(1 << 20)
    h = io.read_hypotheses(spark, str(tmp_path / "hyp__m__s.json"))
    assert h.select("audio_filepath", "hyp").distinct().count() == 500_000 == h.where("hyp = concat('some words of ', regexp_extract(audio_filepath, '[0-9]+', 0))").count()


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_heads(spark, tmp_path, block_bytes, monkeypatch, size):
    names = []
    for k, n in enumerate([5, 0, 40, 3]):
        lines = [json.dumps({"audio_filepath": f"{k}-{i}"}) + ("\n\n  " if i % 7 == 3 else "") for i in range(n)]
        (tmp_path / f"part {k}.json").write_text("\n".join(lines))
        names += [f"{k}-{i}" for i in range(n)]
    block_bytes(size)
    for lines in (10_000, 0):  # taken file by file; cut by blocks
        monkeypatch.setattr(io, "HEAD_LINES", lines)
        for n in (1, 4, 5, 6, 44, 48, 1000):
            assert sorted(r.audio_filepath for r in io.read_manifest_head(spark, str(tmp_path), n).collect()) == sorted(names[:n]), (lines, n)
    assert io.read_manifest_head(spark, str(tmp_path), None).count() == 48


def test_a_head_reads_no_more_than_it_needs(spark, tmp_path, block_bytes):
    """A head of two lines of the first file: neither later files nor later blocks are read, so bad lines there do no harm."""
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"audio_filepath": str(i)}) for i in range(20_000)))
    (tmp_path / "b.json").write_text("nope")
    block_bytes(20_000)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("head", "head")
    assert [r.audio_filepath for r in io.read_manifest_head(spark, str(tmp_path), 2).collect()] == ["0", "1"]
    tasks = sum(seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("head") for s in seen.getJobInfo(j).stageIds if seen.getStageInfo(s))
    spark.sparkContext.setJobGroup("", "")
    assert tasks <= 6


def test_scratch_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_made", {})
    df = scratch.stored(spark.range(5), "kept")
    ((path,),) = scratch._made.values()
    assert df.count() == 5
    scratch.remove_scratch(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not scratch._made
