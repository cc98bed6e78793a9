"""Two cached answers of one time: the later turn counts, whatever the rows' order, as in the SQL's arg_max."""

from hashlib import md5

import __spark_entry__ as entry


def test_later_turn(spark, tmp_path):
    rows = [(1, 0, "user", "question one"), (1, 2, "user", "question b"), (1, 4, "user", "question two"), (2, 0, "user", "question of 2"), (3, 0, "user", "other text")]
    for n, order in enumerate((rows, rows[::-1], [rows[k] for k in (2, 0, 1, 4, 3)])):
        path = tmp_path / str(n)
        spark.createDataFrame(order, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
        for name, want in (("question_cache", {"1-0": "question two", "1-2": "question two", "1-4": "question two", "2-0": "question of 2", "3-0": "other text"}), ("question_cache_whole", {"1-0": "question one"})):
            got = {r["id"]: r["answer"] for r in entry.queries()[name](spark, str(path)).collect()}
            assert {k: got[k] for k in want} == {k: md5(v.encode()).hexdigest() for k, v in want.items()}
