"""Versioned tables: several writers, what a change writes, and what readers see."""

import json
import threading
from pathlib import Path

import pytest

from casequarry.operators import providers
from casequarry.service import CaseStore
from casequarry.sources import tables, versions
from casequarry.sources.versions import Change, ConflictError, VersionedTable, take

BATCH = "entry_id string, seq long, image_hash string, description string, tags array<string>"


def rows(table, commit=None):
    return sorted((tuple(r) for r in table.read(commit).collect()), key=repr)


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def numbers(spark, *values):
    return spark.createDataFrame(values, "k long, v string")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"])


def test_layers_lie_over_the_base(spark, table):
    assert rows(table) == [] and table.latest().version == 0
    table.replace(numbers(spark, (1, "a"), (2, "b"), (None, "n"), (3, "c")))
    first = table.latest()
    table.update(lambda _, at: Change(rows=numbers(spark, (2, "B"), (4, "d"), (None, "N")), gone=numbers(spark, (3, ""), (4, ""))))
    table.update(lambda _, at: Change(gone=numbers(spark, (1, ""), (9, ""))))
    want = [(2, "B"), (4, "d"), (None, "N")]
    assert rows(table) == want and rows(table, first) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    assert {r["k"] for r in table.changed(2, table.latest()).collect()} == {1, 9}
    merged = table.compact(most=2, share=9.0)
    assert len(merged.layers) == 2 and rows(table) == want
    assert {1, 9} <= {r["k"] for r in table.changed(2, merged).collect()}
    assert len(table.compact(share=0.1).layers) == 1 and rows(table) == want
    assert table.update(lambda _, at: None) == table.latest()


def test_several_rows_of_a_key_go_together(spark, table):
    table.update(lambda _, at: Change(rows=numbers(spark, (1, "a"), (1, "b"))))
    table.update(lambda _, at: Change(rows=numbers(spark, (1, "c"), (1, "c"))))
    assert rows(table) == [(1, "c"), (1, "c")]


def interleaved(table, mine, theirs):
    """Make a change, while another is made between reading and committing; how often ``mine`` was asked for."""
    asked = []

    def change(state, at):
        asked.append(at.version)
        if len(asked) == 1:
            table.update(theirs)
        return mine(state)

    table.update(change)
    return len(asked)


def test_changes_that_dont_meet_are_both_kept(spark, table):
    table.replace(numbers(spark, (1, "a"), (2, "b")))
    one = lambda state: Change(rows=numbers(spark, (1, "A")), reads=numbers(spark, (1, "")).select("k"))
    assert interleaved(table, one, lambda _, at: Change(rows=numbers(spark, (2, "B")))) == 1
    assert rows(table) == [(1, "A"), (2, "B")] and table.latest().version == 3


def test_a_change_that_rests_on_another_is_made_anew(spark, table):
    table.replace(numbers(spark, (1, "a"), (2, "b")))

    def longer(state):
        return Change(rows=state.where("k = 1").selectExpr("k", "v || '+' AS v"), reads=numbers(spark, (1, "")).select("k"))

    assert interleaved(table, longer, lambda _, at: Change(rows=numbers(spark, (1, "theirs")))) == 2
    assert rows(table) == [(1, "theirs+"), (2, "b")]
    assert interleaved(table, lambda s: Change(rows=numbers(spark, (5, "e"))), lambda _, at: Change(rows=numbers(spark, (6, "f")))) == 2  # reads unknown
    assert interleaved(table, longer, lambda _, at: Change(gone=numbers(spark, (1, "")))) == 2
    assert rows(table) == [(2, "b"), (5, "e"), (6, "f")]


def test_a_change_that_always_loses_is_an_error_and_changes_nothing(spark, table):
    def change(_, at):
        table.update(lambda _, at: Change(rows=numbers(spark, (at.version, "other"))))
        return Change(rows=numbers(spark, (100, "mine")))

    with pytest.raises(ConflictError):
        table.update(change, attempts=2)
    assert [r[1] for r in rows(table)] == ["other", "other"]


def test_a_name_is_taken_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if take(spark, f"file:{tmp_path}/a b/1.json", f"by {i}") else None) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "a b" / "1.json").read_text() == f"by {won[0]}" and len(list((tmp_path / "a b").iterdir())) == 1


def test_a_half_written_layer_and_draft_dont_count(spark, table, tmp_path):
    table.replace(numbers(spark, (1, "a")))
    (tmp_path / "t" / "layers" / "lost").mkdir()
    (tmp_path / "t" / "commits" / ".draft").write_text("{")
    assert rows(table) == [(1, "a")] and table.update(lambda _, at: Change(rows=numbers(spark, (2, "b")))).version == 2


def store(spark, folder):
    return CaseStore(spark, str(folder), providers.stand_in_embedder(4))


def cases(spark, *values):
    return spark.createDataFrame([(i, s, h, d, []) for i, s, h, d in values], BATCH)


def test_users_who_save_at_once_lose_nothing(spark, tmp_path):
    store(spark, tmp_path).save(cases(spark, ("first", 0, "h", "zero")), "t0")
    failed = []

    def save(user):
        try:
            box = store(spark, tmp_path)
            for i in range(2):
                box.save(cases(spark, (f"{user}-{i}", 10 * user + i, "h", f"{user} {i}"), (f"own-{user}-{i}", 100 * user + i, f"h{user}{i}", "x")), f"t{user}{i}")
        except Exception as error:  # reported below, from the main thread
            failed.append(error)

    threads = [threading.Thread(target=save, args=(user,)) for user in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    box = store(spark, tmp_path)
    found = {r["entry_id"]: r for r in box.cases().collect()}
    assert not failed and len(found) == 7 and found["first"]["version_count"] == 7 and len(found["first"]["version_history"]) == 6
    assert {r["entry_id"] for r in box.vectors().collect()} == set(found)


def test_a_save_writes_its_batch_and_the_index_equals_a_rebuild(spark, tmp_path):
    box = store(spark, tmp_path)
    box.save(spark.range(4000).selectExpr("concat('e', id) AS entry_id", "id AS seq", "sha2(cast(id AS string), 256) AS image_hash", "concat('case ', sha2(cast(id AS string), 512)) AS description", "array() AS tags"), "t0")
    whole = size(tmp_path)
    box.save(cases(spark, ("new", 5000, "other", "a new one"), ("again", 5001, "0" * 64, "x")), "t1")
    assert size(tmp_path) - whole < whole / 10
    box.describe(spark.createDataFrame([("e7", "changed")], "entry_id string, description string"), "t2")
    box.delete(spark.createDataFrame([("e8",), ("nobody",)], "entry_id string"))
    assert size(tmp_path) - whole < whole / 5
    assert box._vectors.latest().source == box._cases.latest().version
    kept = sorted((r["entry_id"], r["ordinal"], tuple(r["text_vec"])) for r in box.vectors().collect())
    assert box.rebuild() == 4001 and kept == sorted((r["entry_id"], r["ordinal"], tuple(r["text_vec"])) for r in box.vectors().collect())


def test_layers_are_merged_as_they_gather(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions.VersionedTable.compact, "__defaults__", (3, 0.25))
    box = store(spark, tmp_path)
    box.save(spark.range(40).selectExpr("concat('e', id) AS entry_id", "id AS seq", "cast(id AS string) AS image_hash", "'d' AS description", "array() AS tags"), "t0")
    for i in range(5):
        box.save(cases(spark, (f"n{i}", 100 + i, str(i), f"again {i}")), f"t{i + 1}")
    assert len(box._cases.latest().layers) <= 4
    found = {r["entry_id"]: r for r in box.cases().collect()}
    assert len(found) == 40 and [found[f"e{i}"]["version_count"] for i in range(7)] == [2] * 5 + [1] * 2 and found["e4"]["description"] == "again 4"


def test_a_store_of_whole_states_is_taken_over(spark, tmp_path):
    tables.replace(spark.createDataFrame([("a", 1, "h", "old one")], "entry_id string, seq long, image_hash string, description string"), f"{tmp_path}/cases")
    tables.replace(spark.createDataFrame([("a", 1, [1.0])], "entry_id string, ordinal long, text_vec array<double>"), f"{tmp_path}/vectors")
    box = store(spark, tmp_path)
    assert box.cases().first()["description"] == "old one" and box.vectors().first()["text_vec"] == [1.0]
    box.save(cases(spark, ("b", 2, "h", "new one")), "t1")
    assert [(r["entry_id"], r["description"]) for r in store(spark, tmp_path).cases().collect()] == [("a", "new one")]
    assert json.loads((tmp_path / "cases" / "commits" / "000000000002.json").read_text())["version"] == 2
