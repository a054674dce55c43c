"""Documents that are broken, missing, rewritten or not yet published."""

from pyspark.sql import functions as F

from moments.operators import documents as dc

SCHEMAS = {"grid": "policy string, chunks array<struct<start_ts:double>>", "links": "entities array<struct<entity_id:string,label:string,mentions:array<map<string,string>>>>"}


def test_versions_and_broken_documents(spark):
    s = dc.DocumentStore(spark, SCHEMAS)
    assert s.read("grid").collect() == [] and s.context("grid", ["links"]).collect() == []
    write = lambda rows: s.write("grid", spark.createDataFrame(rows, "video_id string, document string"))
    write([("a", '{"policy":"old",\n"chunks":[]}'), ("b", "{broken"), ("c", '{"policy":3,"chunks":"none"}'), ("d", None), ("e", "{}"), ("fü", '{"policy":"tab\\there"}')])
    write([("a", '{"policy":"new","chunks":[{"start_ts":1.5}],"extra":1}')])
    # a version that no pointer names is not read
    spark.createDataFrame([("a\t{}",)], "value string").write.text(f"{s.root}/grid/v3")
    got = {r.video_id: r for r in s.read("grid").collect()}
    assert got["a"].document.policy == "new" and got["a"].document.chunks[0].start_ts == 1.5
    assert got["b"].document is None and got["b"]._raw == "{broken"
    assert got["c"].document is None and got["d"].document is None
    assert got["e"].document.policy is None and got["e"]._raw is None
    assert got["fü"].document.policy == "tab\there"
    found = {(r.video_id, r.problem) for r in s.problems("grid", {"no policy": F.col("document.policy").isNotNull()}).collect()}
    assert found == {("b", "cannot be read"), ("c", "cannot be read"), ("d", "cannot be read"), ("e", "no policy")}
    assert {r.video_id: r.links for r in s.context("grid", ["links"]).collect()} == {"a": None, "e": None, "fü": None}


def test_entities_and_mentions(spark):
    s = dc.DocumentStore(spark, SCHEMAS)
    text = '{"entities":[{"entity_id":"e0","label":"Ann","mentions":[{"key":"k","chunk":"4","sampler":"clip","wears":"red"},{"chunk":"5","doubt":"dark"}]},{"entity_id":"e1","mentions":[]}]}'
    s.write("links", spark.createDataFrame([("a", text)], "video_id string, document string"))
    entities, mentions = dc.entity_rows(s.read("links"))
    assert sorted(map(tuple, entities.collect()), key=str) == [("a", "e0", "Ann", 2), ("a", "e1", None, 0)]
    assert [tuple(r) for r in mentions.orderBy("place").collect()] == [("a", "e0", 0, 4, "clip", None, {"wears": "red"}), ("a", "e0", 1, 5, None, "dark", {})]
