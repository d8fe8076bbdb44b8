"""The ledger of model calls, and requests and answers as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from skein.sources.clients import CannedChat, CannedEmbed, CannedGenerate, Generation
from skein.sources.exchange import Part, _lines, register
from skein.sources.ledger import Journal, Ledger, ask_once, embed_once, generate_once
from skein.sources.requests import with_defaults


class Counted:
    """Writes a line for each call; fails for texts that a file names."""

    model = "m"

    def __init__(self, folder):
        self.calls, self.broken = f"{folder}/calls", f"{folder}/broken"

    def chat(self, system, user, json=False):
        with open(self.calls, "a") as f:
            f.write(user + "\n")
        if os.path.exists(self.broken) and user in open(self.broken).read().split():
            raise TimeoutError("no answer")
        return f"{system}|{user}"

    def made(self):
        return sorted(open(self.calls).read().split("\n"))[1:] if os.path.exists(self.calls) else []


def test_equal_requests_are_one_call(spark, tmp_path):
    client, ledger = Counted(tmp_path), Ledger(spark, str(tmp_path / "ledger"))
    (tmp_path / "broken").write_text("b")
    # One request in most rows, a null, an empty text, one that fails.
    rows = spark.createDataFrame([(i, "hot" if i < 600 else ["a", "b", None, ""][i % 4]) for i in range(900)], "id long, error_not string")
    got = {r.id: r for r in ask_once(rows, ledger, client, "s", "error_not").collect()}
    assert len(got) == 900 and client.made() == ["", "a", "b", "hot"]
    for i, r in got.items():
        want = "hot" if i < 600 else ["a", "b", "", ""][i % 4]
        assert (r.answer, r.error) == ((None, "TimeoutError: no answer") if want == "b" else (f"s|{want}", None))
    # Only the failed one is asked again; another system text is another request.
    (tmp_path / "broken").unlink()
    assert ask_once(rows, ledger, client, "s", "error_not").where("answer is null").count() == 0
    assert client.made() == ["", "a", "b", "b", "hot"]
    ask_once(rows.limit(1), ledger, client, "t", "error_not").collect()
    assert client.made().count("hot") == 2
    assert ask_once(rows.where("id < 0"), ledger, client, "s", "error_not").count() == 0


def test_a_retried_task_asks_for_nothing_twice(spark, tmp_path):
    """A task's first run is lost in the middle; the journal has what it was told."""
    j = Journal(f"{tmp_path}/run/3", 1)
    for k in "ab":
        j.add({"key": k, "payload": k.upper(), "error": None, "latency_ms": 1.0, "asked_at": 2.0})
    j.add({"key": "c", "payload": None, "error": "E: lost", "latency_ms": 1.0, "asked_at": 2.0})
    (tmp_path / "run" / "3" / "half.part").write_text('{"key": "d", "pay')
    again = Journal(f"{tmp_path}/run/3", 1)
    assert {k: r["payload"] for k, r in again.told.items()} == {"a": "A", "b": "B"}
    assert not Journal(f"{tmp_path}/run/4", 1).told


def test_what_a_failed_job_was_told_is_kept(spark, tmp_path):
    class Killed(Counted):
        def chat(self, system, user, json=False):
            if user == "5":
                raise SystemExit("the worker dies")  # no Exception: the task fails, and its job
            return super().chat(system, user, json)

    rows = spark.range(8).select(F.col("id").cast("string").alias("u"))
    ledger, client = Ledger(spark, str(tmp_path / "ledger")), Killed(tmp_path)
    with pytest.raises(Exception):
        ask_once(rows, ledger, client, "", "u", parallel=1).collect()
    before = client.made()
    assert before == sorted(set(before)) and "5" not in before
    got = ask_once(rows, ledger, Counted(tmp_path), "", "u", parallel=2)
    assert sorted(r.answer for r in got.collect()) == [f"|{i}" for i in range(8)]
    assert Counted(tmp_path).made() == list("01234567")
    assert not list((tmp_path / "ledger" / "journal").iterdir())


def test_generations_and_vectors_through_a_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), every=10)
    rows = spark.createDataFrame([(1, 'say "x"\n'), (2, "two"), (3, "two")], "id long, prompt string")
    made = generate_once(rows, ledger, CannedGenerate(lambda p: Generation(p * 2, 3, 0.5))).orderBy("id").collect()
    assert [(r.made_text, r.made_tokens, r.made_seconds, r.made_error) for r in made] == [(p * 2, 3, 0.5, None) for p in ('say "x"\n', "two", "two")]
    # The same texts asked of another kind of model are other requests.
    vectors = embed_once(rows, ledger, CannedEmbed(lambda t: [len(t), 0.1]), "prompt", "v").orderBy("id").collect()
    assert [r.v for r in vectors] == [[8.0, 0.1], [3.0, 0.1], [3.0, 0.1]] and ledger.rows().count() == 4


def test_lines_belong_to_the_part_they_start_in(tmp_path):
    lines = [b"{}", b"", b'{"prompt": "' + b"x" * 50 + b'"}', b"[1]", "é²".encode(), b"last"]
    (tmp_path / "a.json").write_bytes(b"\n".join(lines))
    size, want, place = (tmp_path / "a.json").stat().st_size, [], 0
    for line in lines:
        want += [(place, line)] if line else []
        place += len(line) + 1
    for split in (1, 2, 7, 60, 1000):
        got = [x for lo in range(0, size, split) for x in _lines(str(tmp_path), Part(str(tmp_path / "a.json"), lo, min(lo + split, size)))]
        assert got == want, split


def test_reading_writing_and_failing(spark, tmp_path):
    register(spark)
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a\nb", 0.5, None), (2, None, float("nan"), True), (2**60, "é", -1.0, False)], "n long, t string, x double, b boolean")
    rows.repartition(3).write.format("exchange").mode("append").save(folder)
    back = spark.read.format("exchange").schema("t string, n long, b boolean, x double, id string, none string")
    assert sorted((r.n, r.t, r.b) for r in back.load(folder).collect()) == [(1, "a\nb", None), (2, None, True), (2**60, "é", False)]
    assert back.load(folder).select("id").distinct().count() == 3
    # A task that fails leaves no file to be read, nor does its job; a sibling that is killed late may leave a hidden folder.
    def seen():
        return sorted(n for n in os.listdir(folder) if not n.startswith("_writing-"))

    before = seen()
    with pytest.raises(Exception):
        spark.range(8, numPartitions=2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("late"))).otherwise(F.col("id").cast("string")).alias("t")).write.format("exchange").mode("append").save(folder)
    assert seen() == before and back.load(folder).count() == 3
    rows.limit(1).write.format("exchange").mode("overwrite").save(folder)
    assert back.load(folder).count() == 1
    assert spark.read.format("exchange").load(str(tmp_path / "nothing")).count() == 0


def test_odd_lines(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    odd = ["[1]", "{", '{"t": 5, "n": "5"}', '{"t": {"a": 1}, "n": 1e400}', '{"t": "\\ud800", "n": 2.0}', '{"n": 99999999999999999999}', "[" * 100_000, '{"n": true}']
    (tmp_path / "in" / "x.json").write_text("\n".join(odd))
    (tmp_path / "in" / "_half").write_text("{}")
    got = spark.read.format("exchange").option("split", 50_000).schema("id string, t string, n long").load(str(tmp_path / "in"))
    rows = sorted(got.collect(), key=lambda r: int(r.id.split(":")[1]))
    assert [(r.t, r.n) for r in rows] == [(None, None), (None, None), ("5", None), ('{"a": 1}', None), ("?", 2), (None, None), (None, None), (None, None)]
    with pytest.raises(Exception):
        spark.read.format("exchange").schema("t array<string>").load(str(tmp_path / "in")).collect()


def test_a_stream_reads_every_whole_line_once(spark, tmp_path):
    """Files that grow, a late file with an earlier name, a half line; each round starts from the checkpoint."""
    register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        s = spark.readStream.format("exchange").load(str(folder))
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination(25)
        return sorted(r.line for r in spark.read.parquet(out).collect())

    (folder / "m.json").write_text('{"a": 1}\n{"a": 2}\n{"a"')
    assert run() == ['{"a": 1}', '{"a": 2}']
    with open(folder / "m.json", "a") as f:
        f.write(': 3}\n')
    (folder / "b.json").write_text('{"a": 0}\n')
    assert run() == [f'{{"a": {i}}}' for i in range(4)]
    assert len(run()) == 4


def test_every_false_field_has_its_default(spark):
    lines = ['{"prompt":"p","mode":"keyword","rrfK":5}', '{"prompt":"","mode":"","rrfK":0}', '{"prompt":null,"mode":null,"rrfK":null}', '{"rrfK":" 7 "}',
             '{"rrfK":"x","prompt":3}', '{"rrfK":true}', '{"rrfK":false}', '{"rrfK":-2.5}', "[1]", "no", '{"rrfK":"NaN"}', '{"rrfK":[4]}']
    got = with_defaults(spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")).orderBy("i").collect()
    assert [(r.prompt, r.mode) for r in got] == [("p", "keyword")] + [("", "hybrid")] * 11
    assert [r.rrf_k for r in got] == [5, 60, 60, 7, 60, 1, 60, -2.5, 60, 60, 60, 60]
