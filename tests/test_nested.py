import json
import random

from logfold.operators.nested import flatten, linked_records


def brute(key, text):
    out = []

    def walk(v, path, owner, element):
        if isinstance(v, dict):
            if element:
                out.append((key, path, owner))
                owner = path
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, owner, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", owner, True)

    walk(json.loads(text), "", "", False)
    return out


def value(rnd, depth=0):
    x = rnd.random()
    if depth > 6 or x < 0.3:
        return rnd.choice([1, None, True, 'a"b', "\\", "[{", "x,y:z", 1.5, "", '{"in":[{}]}', "\\\\\""])
    if x < 0.65:
        return {rnd.choice(["a", 'b"', "c\\", "d.e", "é", f"k{rnd.randint(0, 9)}"]): value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}
    return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]


BAD = ['{"a":[{}', "[}", '{"a":[{]}', '"', "", '[{"a":1}]]', "[{},]", "nope", '[{"a":"x\\"}]', "[{}] x", "[{'a':1}]", "[{\"a\":NaN}]"]


def test_random_texts_against_brute_force():
    rnd = random.Random(1)
    texts = [json.dumps(value(rnd), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])) for _ in range(1500)] + BAD * 3
    rnd.shuffle(texts)
    keys, paths, parents, bodies = flatten(list(range(len(texts))), [t.encode() for t in texts], True)
    want = [r for i, t in enumerate(texts) if t not in BAD for r in brute(i, t)]
    assert sorted(zip(keys, paths, parents)) == sorted(want)
    assert all(isinstance(json.loads(b), dict) for b in bodies)


def test_paths_and_links(spark, rows):
    text = '{"data": {"a": [1, {"b": [[], {"c": 1}, [{"d": [{}]}]]}]}, "t": "[{}]"}'
    df = spark.createDataFrame([(1, text, "x", 1), (2, '[{"x":[{}]}]', "x", 1)], "row_no bigint, data string, row_key string, k int")
    assert rows(linked_records(df, "row_no", "data")) == sorted([
        (1, "data.a[1]", ""), (1, "data.a[1].b[1]", "data.a[1]"), (1, "data.a[1].b[2][0]", "data.a[1]"), (1, "data.a[1].b[2][0].d[0]", "data.a[1].b[2][0]"),
        (2, "[0]", ""), (2, "[0].x[0]", "[0]"),
    ])


def test_nulls_repeats_long_and_empty(spark, rows):
    long = json.dumps({"a": [{"n": i, "t": "y" * 50} for i in range(30_000)]})
    df = spark.createDataFrame([(1, None), (2, ""), (None, '[{"a":1}]'), (3, "[{}]"), (3, "[{}]"), (4, long)], "row_no bigint, data string")
    got = linked_records(df, "row_no", "data", with_text=True, block_bytes=1000)
    assert got.where("row_key = 4").count() == 30_000
    assert rows(got.where("row_key is null or row_key < 4")) == [(None, "[0]", "", '{"a":1}'), (3, "[0]", "", "{}"), (3, "[0]", "", "{}")]
    assert linked_records(df.limit(0), "row_no", "data").count() == 0


def test_very_deep():
    text = "[" * 400 + "{}" + "]" * 400
    assert flatten([1], [text.encode()], False)[1] == ["[0]" * 400]
