import random

import duckdb

from briefloom.llm.line_dedup import LINE_DEDUP_SQL, dedup_lines, without_repeated_lines


def brute(docs):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        if text is None:
            out[i] = (0, 0, None)
            continue
        lines, gone = text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if "".join(window).replace(" ", ""):
                if window in seen:
                    gone |= {at, at + 1, at + 2}
                seen.add(window)
        out[i] = (len(lines), len(gone), "\n".join(line for k, line in enumerate(lines) if k not in gone))
    return out


def test_against_brute_force_and_sql(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.choice([0, 1, 2, 3, 5, 12])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\nx\nx\nx\nx"), (104, "long " * 4000 + "\nb\nc"), (105, "long " * 4000 + "\nb\nc")]
    df = spark.createDataFrame([(i, t, "l", 3) for i, t in docs], "doc_id long, text string, lines string, n_lines int").repartition(3)
    got = {r["_row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(df).collect()}
    assert got == brute(docs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert {r[0]: tuple(r[1:]) for r in con.execute(LINE_DEDUP_SQL).fetchall()} == got


def test_repeated_rows_and_columns(spark):
    rows = [(1, "a\nb\nc", "k"), (1, "a\nb\nc", "k"), (1, "z\na\nb\nc", "k"), (None, "a\nb\nc", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string")
    out = without_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", ""), ("1", ""), ("1", "z"), ("None", "a\nb\nc")]
    assert without_repeated_lines(df.limit(0)).count() == 0
