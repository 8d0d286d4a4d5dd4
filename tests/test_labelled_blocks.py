"""Files of a set are paired in several tasks, each pair once."""

from tessera.operators import training


def test_a_set_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 7)
    names = [(s, f"para_{'orig' if i % 3 else 'copy'}_{i // 2}_{s}") for s in "xy" for i in range(60)] + [("x", "para_orig_99999999999_x"), ("x", "other_orig_1"), ("z", "para_copy_1_z")]
    files = spark.createDataFrame(names, "set string, name string")
    split = [(s, n, n.split("_")[1], int(n.split("_")[2])) for s, n in names if n.startswith("para") and "999999" not in n]
    want = [("para", a, b) for s, a, p, i in split for t, b, q, j in split if s == t and (p, q) == ("orig", "copy") and i == j]
    want += [("unrelated", a, b) for s, a, p, i in split for t, b, q, j in split if s == t and p == "orig" and (q == "orig" and i < j or q == "copy" and i != j)]
    found = training.labelled_pairs(files, "para")
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 1000
    rows = files.selectExpr("set", "name", "split(name, '_')[1] as role", "cast(split(name, '_')[2] as bigint) as i").where("name like 'para%'")
    orig = rows.where("role = 'orig'").selectExpr("set", "name as a", "i as ia")
    assert training._in_blocks(orig, rows).where("set = 'x'").select("block").distinct().count() == -(-41 // 7)
