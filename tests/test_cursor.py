import io
import json
import os
import random

import pytest

from briefloom.sources.cursor import AccountPosts, AccountStream, Folder, lines_that_end


def line(i, **more):
    return json.dumps({"id": str(i), "text": f"t{i}", "created_at": "now", "conversation_id": "c"} | more) + "\n"


def append(folder, account, text):
    with open(f"{folder}/{account}.jsonl", "a", encoding="utf-8") as file:
        file.write(text)


def drained(spark, folder, place, options=()):
    stream = spark.readStream.format("account_posts").options(path=str(folder), **dict(options)).load()
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("cuts", [[], [1], [7, 7, 8], list(range(0, 60, 3))])
def test_every_line_ends_in_one_range(cuts):
    data = b"one\n\nthree is longer\n" + b"x" * 40 + b"\nlast\nunfinished"
    bounds = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
    got = [x for a, b in zip(bounds, bounds[1:], strict=False) for x in lines_that_end(io.BytesIO(data), a, b)]
    assert got == data.split(b"\n")[:-1]


def test_long_lines_are_found_from_any_cut():
    data = b"\n".join(bytes([97 + i]) * 70_000 for i in range(5)) + b"\n"
    bounds = [0, 1, 65_536, 70_000, 70_001, 200_000, len(data)]
    got = [x for a, b in zip(bounds, bounds[1:], strict=False) for x in lines_that_end(io.BytesIO(data), a, b)]
    assert got == data.split(b"\n")[:-1]


def test_a_thousand_accounts_restart_and_failed_accounts(spark, tmp_path):
    spark.dataSource.register(AccountPosts)
    folder, rng, want = tmp_path / "posts", random.Random(1), set()
    folder.mkdir()
    ids = iter(range(10**6))

    def write(accounts):
        for a in accounts:
            new = [next(ids) for _ in range(rng.choice([1, 2, 9]))]
            append(folder, a, "".join(map(line, new)))
            want.update((a, i) for i in new)

    def stored():
        rows = [(r["account"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    write([f"a{k}" for k in range(1000)])
    append(folder, "broken", '{\n[]\n{"text": "no id"}\n{"id": "x"}\n')
    append(folder, "a0", line(next(ids))[:-9])  # still being written
    drained(spark, folder, tmp_path, {"partition_bytes": "4000"})
    assert stored() == want
    write(["a1", "a2", "new"])
    append(folder, "a0", line(0)[-9:])
    want.add(("a0", next(iter({int(json.loads(x)["id"]) for x in open(f"{folder}/a0.jsonl")} - {i for a, i in want if a == "a0"}))))
    (folder / "gone.jsonl").write_text(line(77))
    folder_of = AccountStream({"path": str(folder)})
    end = folder_of.latestOffset()
    os.remove(folder / "gone.jsonl")
    assert [p for part in folder_of.partitions({a: n for a, n in end.items() if a != "gone"}, end) for p in folder_of.read(part)] == []
    drained(spark, folder, tmp_path)  # a restart from the checkpoint
    assert stored() == want
    assert end["a5"] == os.path.getsize(folder / "a5.jsonl") and set(end) >= {"a0", "a999", "broken"}


def test_partitions_are_even_and_share_a_long_file(tmp_path):
    append(tmp_path, "long", "".join(map(line, range(2000))))
    append(tmp_path, "short", line(1))
    folder = Folder({"path": f"file://{tmp_path}", "partition_bytes": "5000"})
    packs = folder.packed({}, folder.lengths())
    assert max(sum(e - s for _, s, e in p.value) for p in packs) == 5000 and len(packs) > 20
    assert sorted(r[1] for p in packs for r in folder.posts(p) if r[0] == "long") == list(range(2000))


def test_batch_choice_and_empty_folder(spark, tmp_path):
    spark.dataSource.register(AccountPosts)
    append(tmp_path, "a", line(5) + line(3, text=None) + "nonsense\n" + line(9, text={"x": 1}))
    append(tmp_path, "b", line(6))
    read = lambda **o: spark.read.format("account_posts").options(**o).load()
    assert sorted((r["id"], r["text"]) for r in read(path=str(tmp_path), accounts="@A, missing,a").collect()) == [(3, None), (5, "t5"), (9, "{'x': 1}")]
    assert read(path=str(tmp_path)).count() == 4
    (tmp_path / "none").mkdir()
    assert read(path=str(tmp_path / "none")).count() == 0 == read(path=str(tmp_path / "absent")).count()
