"""CSV logs with unlike headers (S1-S3) through the whole coding chain."""

import os
import tempfile

from trialstats.plans.trials import code_trials
from trialstats.sources.csv_logs import ORDER_KEY, read_trials
from trialstats.sources.sinks import write_summary


def _write(folder, name, header, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def _log(cb, kind, order):
    """Header and rows of one participant's log (counterbalance ``cb``, one block of ``kind``)."""
    cols = ["participant", "Cue", "Task", "Block"]
    for t in ("shape", "loc"):
        cols += [f"both_{t}_cb{cb}_{kind}.keys", f"both_{t}_cb{cb}_{kind}.rt", f"both_{t}_cb{cb}_{kind}.corr"]
    cols += [f"nBlocks{kind.capitalize()}Cb{cb}.thisRepN", f"nBlocks{kind.capitalize()}Cb{cb}.thisTrialN",
             f"nTrials{kind.capitalize()}Cb{cb}.thisN"]
    block = "mixed" if kind == "mix" else "freeOnly"
    pid = {1: 101, 2: 102, 4: 104}[cb]
    # practice row (no corr, no loop counter), 4 trials: loc, shape, shape, no response; block-end row
    trials = [
        dict(Cue="XXXX", Task="free", Block=block, keys_loc="x", rt_loc=0.51, corr_loc=1, n=0),
        dict(Cue="JAKI", Task="forced", Block=block, keys_shape="m", rt_shape=0.62, corr_shape=1, n=1),
        dict(Cue="JAKI", Task="forced", Block=block, keys_shape="m", rt_shape=0.73, corr_shape=0, n=2),
        dict(Cue="GDZIE", Task="free", Block=block, keys_loc="None", rt_loc=0.84, corr_loc=0, n=3),
    ]
    rows = [{"participant": pid, "Cue": "XXXX", "Task": "free", "Block": block}]
    for t in trials:
        r = {"participant": pid, "Cue": t["Cue"], "Task": t["Task"], "Block": t["Block"]}
        for task in ("shape", "loc"):
            r[f"both_{task}_cb{cb}_{kind}.keys"] = t.get(f"keys_{task}", "None")
            r[f"both_{task}_cb{cb}_{kind}.rt"] = t.get(f"rt_{task}")
            r[f"both_{task}_cb{cb}_{kind}.corr"] = t.get(f"corr_{task}", 888)
        r[f"nTrials{kind.capitalize()}Cb{cb}.thisN"] = t["n"]
        rows.append(r)
    rows.append({"participant": pid, f"nBlocks{kind.capitalize()}Cb{cb}.thisRepN": 0,
                 f"nBlocks{kind.capitalize()}Cb{cb}.thisTrialN": 0})
    header = cols[::-1] if order == "reversed" else cols
    return header, [[r.get(c) for c in header] for r in rows]


def test_unlike_headers_are_stacked_by_name(spark):
    folder = tempfile.mkdtemp(prefix="trialstats-csv-")
    h1, r1 = _log(1, "mix", None)
    h2, r2 = _log(2, "free", "reversed")                    # another column order
    h4, r4 = _log(4, "mix", None)
    _write(folder, "p101.csv", h1, r1)
    _write(folder, "p102.csv", h2, r2)
    _write(folder, "p104.csv", h4, r4)
    _write(folder, "notes.txt", ["x"], [[1]])               # not matched by the glob
    raw = read_trials(spark, folder)
    assert raw.count() == 3 * 6
    assert "both_loc_cb2_free_keys" in raw.columns and "both_loc_cb4_mix_keys" in raw.columns
    assert raw.select("file_name").distinct().count() == 3
    # values must sit under their own column whatever the file's column order
    p102 = raw.where("participant = '102' AND Cue = 'JAKI'").select("both_shape_cb2_free_rt").collect()
    assert sorted(float(r[0]) for r in p102) == [0.62, 0.73]

    trials = code_trials(raw, keys_order=("file_name", "file_block_start", "seq"), file_key="file_name")
    rows = sorted(trials.collect(), key=lambda r: (r.id, r.trialNr))
    assert len(rows) == 3 * 4          # the no-response trial (corr 0, resp '') is kept, as in the reference
    first = [r for r in rows if r.id == 102]
    assert [r.task_perf for r in first] == ["loc", "shape", "shape", "shapeloc"]
    assert [r.resp for r in first] == ["x", "m", "m", ""]
    assert [r.switch_type for r in first] == [None, "switch_shape", "stay_shape", None]
    assert {r.blockNr for r in rows} == {1}
    assert {r.cBal for r in rows if r.id == 102} == {"free-mix"}
    assert [r.rt for r in first] == [0.51, 0.62, 0.73, 0.84]
    assert [r.trialNr for r in first] == [1, 2, 3, 4]

    # the file split is the natural segment of a CSV row order: the segmented scans agree
    from pyspark.sql import functions as F
    seg = code_trials(raw, keys_order=("file_name", "file_block_start", "seq"), file_key="file_name",
                      segment=F.col("file_block_start"))
    assert sorted(map(tuple, seg.collect())) == sorted(map(tuple, trials.collect()))

    out = os.path.join(folder, "out")
    write_summary(trials, out)
    assert spark.read.parquet(out).count() == 12


def test_row_order_survives_file_splits(spark):
    """SURVEY §1.4: (file_name, file_block_start, seq) sorts rows as they lie in the file, even when
    one file is read by many tasks; the split is a valid segment of the ordered scans."""
    from pyspark.sql import functions as F

    folder = tempfile.mkdtemp(prefix="trialstats-split-")
    header = ["participant", "Cue", "Task", "Block", "both_loc_cb1_mix.keys", "both_loc_cb1_mix.rt",
              "both_loc_cb1_mix.corr", "both_shape_cb1_mix.keys", "both_shape_cb1_mix.rt", "both_shape_cb1_mix.corr",
              "nBlocksMixCb1.thisRepN", "nBlocksMixCb1.thisTrialN", "nTrialsMixCb1.thisN"]
    rows = []
    for i in range(3000):
        loc = (i * 7919) % 3 != 0
        rows.append([201, "XXXX", "free", "mixed", "x" if loc else "None", f"0.{i % 97 + 100}" if loc else "",
                     "1" if loc else "888", "None" if loc else "m", "" if loc else f"0.{i % 89 + 100}",
                     "888" if loc else "0", "", "", i])
    rows[-1][10], rows[-1][11] = 0, 0
    _write(folder, "p201.csv", header, rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = read_trials(spark, folder)
        assert raw.select("file_block_start").distinct().count() > 5           # really split
        ordered = [r[0] for r in raw.orderBy("file_name", "file_block_start", "seq")
                   .select(F.col("nTrialsMixCb1_thisN").cast("int")).collect()]
        assert ordered == list(range(3000))
        keys = ("file_name", "file_block_start", "seq")
        plain = code_trials(raw, keys_order=keys, file_key="file_name")
        split = code_trials(raw, keys_order=keys, file_key="file_name", segment=F.col("file_block_start"))
        a, b = sorted(map(tuple, plain.collect())), sorted(map(tuple, split.collect()))
        assert a == b and len(a) == 3000
        assert [r.trialNr for r in sorted(plain.collect(), key=lambda r: r.trialNr)][:3] == [1, 2, 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_of_one_name_stay_apart(spark):
    """The block number is back-filled within a file; two folders may hold files of one name."""
    folder = tempfile.mkdtemp(prefix="trialstats-same-")
    for sub, cb in (("a", 1), ("b", 4)):
        os.mkdir(os.path.join(folder, sub))
        header, rows = _log(cb, "mix", None)
        _write(os.path.join(folder, sub), "log.csv", header, rows[:-1] if sub == "a" else rows)  # a: no block-end row
    raw = read_trials(spark, folder, recursive=True)
    assert raw.select("file_name").distinct().count() == 1 and raw.select("file_path").distinct().count() == 2
    got = code_trials(raw, keys_order=ORDER_KEY, file_key="file_path").select("id", "blockNr").distinct().collect()
    assert sorted(map(tuple, got)) == [(101, None), (104, 1)]


class _Counting:
    """A stream that counts what is read from it."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        part = self.data[self.at:self.at + n]
        self.at += len(part)
        return part


def test_only_heads_are_read(spark):
    """Files with large bodies: one block a file is read, the headers are reduced to the distinct ones."""
    from trialstats.sources.csv_logs import HEAD_BLOCK, distinct_headers, file_headers, read_head

    big = _Counting(b"a,b,c\r\n" + b"1,2,3\r\n" * 2_000_000)
    assert read_head(big) == "a,b,c" and big.at == HEAD_BLOCK
    wide = _Counting(("x" * 40_000 + "\n" + "y" * 100_000).encode())
    assert read_head(wide) == "x" * 40_000 and wide.at == 3 * HEAD_BLOCK
    assert read_head(_Counting(b"\xef\xbb\xbfid,n")) == "id,n" and read_head(_Counting(b"")) == ""

    folder = tempfile.mkdtemp(prefix="trialstats-heads-")
    os.mkdir(os.path.join(folder, "a b"))
    for i in range(40):
        _write(folder if i % 2 else os.path.join(folder, "a b"), f"p {i}.csv", ["id", "x"] if i % 4 else ["x", "id"], [[i, i]] * 50)
    got = {r["header"]: r["files"] for r in distinct_headers(spark, folder, recursive=True).collect()}
    assert got == {"id,x": 30, "x,id": 10}
    assert len(file_headers(spark, folder)) == 20
    raw = read_trials(spark, folder, recursive=True)
    assert raw.count() == 2000 and raw.where("id <> x").count() == 0
