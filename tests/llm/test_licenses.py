import duckdb

from castmill.llm import licenses


def brute(text):
    """Label, start and score of every key phrase at every place."""
    words, out = licenses.words_of(text), []
    for (label, _, _), key, whole, at in zip(licenses.TEMPLATES, licenses.KEYS, licenses.TEXTS, licenses.AT):
        for s in range(len(words)):
            if words[s : s + len(key)] == key:
                same = sum(0 <= s - at + j < len(words) and words[s - at + j] == w for j, w in enumerate(whole))
                out.append((label, s, round(same / len(whole), 9)))
    return sorted(out)


def test_places_by_brute_force(spark):
    """Whole licence texts, with words lost, cut at the front, with the key broken, and mere words of one."""
    mit, bsd = licenses.TEMPLATES[3][2], licenses.TEMPLATES[5][2]
    some = [mit, "Copyright X. " + mit.replace("sublicense,", "") + bsd, " ".join(mit.split()[5:]), mit.replace("charge", "cost"), "merchantability sublicense furnished",
            "under the MIT license " * 50, "released under the mit license", "CC BY-NC 4.0 and cc by nc", "isc the isc license", "gnu gnu general public license version 2 3", "é under the mit licenseé", ""]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    found = {r["doc_id"]: sorted((f["label"], f["start"], round(f["score"], 9)) for f in r["found"]) for r in licenses.scan_licenses(docs).collect()}
    assert found == {i: brute(t) for i, t in enumerate(some)}
    assert found[0] == [("mit", 0, 1.0)] and {x[0] for x in found[1]} == {"mit", "bsd"} and not found[3] and not found[4]


def test_documents_by_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = licenses.op1_licenses(spark, sf_dir)
    cols = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({licenses.ORACLE_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(cols).collect()))) == sorted(map(str, want))
