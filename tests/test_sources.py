import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from innsight import load_cluster
from innsight.sources import locations as places
from innsight.sources import region, sinks
from innsight.sources import reviews as src

HEADER = "property_id,platform,date,rating,text,language_hint"
ROWS = ["Property A,GoogleMaps,2024-01-05,5,Great food and clean room,en",
        'Property B,Booking,2024-02-10,2,"Rude staff, dirty\nbathroom",en']


def write(path, rows, header=HEADER):
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return str(path)


def frame(spark, **change):
    row = dict(property_id="A", platform="web", date="2024-01-05", rating="4", text="ok",
               language_hint="en") | change
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def dates(spark, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, date {kind}")
    return [str(r["date"]) for r in src.parse_dates(df).orderBy("i").collect()]


def test_csv_json_jsonl(spark, tmp_path):
    csv = src.load_reviews(spark, write(tmp_path / "a.csv", ROWS))
    assert csv.count() == 2 and csv.where("text like '%\n%'").count() == 1
    records = [dict(zip(HEADER.split(","), r.split(","), strict=True)) for r in ROWS[:1]]
    (tmp_path / "b.json").write_text(json.dumps(records))
    (tmp_path / "c.jsonl").write_text(json.dumps(records[0]) + "\n")
    for name in ("b.json", "c.jsonl"):
        assert src.load_reviews(spark, str(tmp_path / name)).first()["rating"] == 5.0
    with pytest.raises(src.SchemaError):
        src.read_frame(spark, "x.xlsx")


def test_identity_columns(spark):
    df = frame(spark).withColumn("Reviewer_Name ", F.lit("x")).withColumn("EMAIL", F.lit("y"))
    assert src.drop_identity_columns(df).columns == HEADER.split(",")


@pytest.mark.parametrize("change", [{"rating": "9"}, {"text": "  "}, {"text": None},
                                    {"date": "someday"}, {"date": None}, {"rating": "many"}])
def test_rejected(spark, change):
    with pytest.raises(src.SchemaError):
        src.validate_reviews(frame(spark, **change))
    with pytest.raises(src.SchemaError, match="no column for required"):
        src.validate_reviews(frame(spark).drop("text"))


def test_dates(spark):
    assert dates(spark, ["2025-06-30 20:00", "2025-06-30"]) == [
        "2025-06-30 20:00:00", "2025-06-30 00:00:00"]
    assert set(dates(spark, ["2025-06-30T14:30:00Z", "2025-06-30T20:00:00+05:30",
                             "2025-06-30 20:00:00"])) == {"2025-06-30 20:00:00"}
    assert dates(spark, ["2025-01-01T23:30:00+00:00"]) == ["2025-01-02 05:00:00"]
    assert dates(spark, ["05/01/2024", "06/02/2024"]) == [
        "2024-05-01 00:00:00", "2024-06-02 00:00:00"]
    assert dates(spark, ["13/01/2024", "05/01/2024"])[1] == "2024-01-05 00:00:00"
    with pytest.raises(src.SchemaError):
        dates(spark, ["05/01/2024", "13/01/2024"])
    assert dates(spark, ["5 Jan 2024", "12 March 2024"])[1] == "2024-03-12 00:00:00"
    for epoch in (1706731200, 1706731200000, 1706731200000000):
        assert dates(spark, [epoch], "long") == ["2024-02-01 01:30:00"]


def test_repeats_across_files(spark, tmp_path):
    write(tmp_path / "1.csv", [ROWS[0], ROWS[0]])
    write(tmp_path / "2.csv", [ROWS[0].replace(",5,", ",5.0,"), ROWS[1]])
    assert src.load_dir(spark, str(tmp_path)).count() == 3  # two inside file 1, one new
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        src.load_dir(spark, str(tmp_path / "empty"))


def test_partner_export(spark):
    df = spark.createDataFrame(
        [("H1", "web", "2024-01-05", "4", "fine", "en", "someone")],
        "hotel_code string, channel string, `Review-Date` string, stars string, "
        "review_body string, lang string, reviewer_name string")
    mapped = src.adapt_frame(df, {"property_id": "hotel_code", "text": "review_body"})
    assert mapped.columns == ["property_id", "platform", "date", "rating", "text", "language_hint"]
    with pytest.raises(src.SchemaError, match="no such column"):
        src.adapt_frame(df, {"property_id": "hotel_code", "text": "reviewer_name"})
    two = df.withColumn("comment", F.lit("x")).withColumnRenamed("review_body", "review_text")
    with pytest.raises(src.SchemaError, match="ambiguous"):
        src.map_columns(two, {"property_id": "hotel_code"})
    with pytest.raises(src.SchemaError, match="no such field"):
        src.map_columns(df, {"colour": "lang"})


def test_review_ids(spark):
    rows = frame(spark).unionByName(frame(spark)).unionByName(frame(spark, text="other"))
    ids = [r["review_id"] for r in src.assign_review_ids(rows).collect()]
    assert len(set(ids)) == 3
    assert set(ids) == {r["review_id"] for r in src.assign_review_ids(rows.repartition(3)).collect()}
    with pytest.raises(src.SchemaError):
        src.with_review_ids(rows.withColumn("review_id", F.lit(1)))


def test_locations(spark):
    good = spark.createDataFrame([(" A ", "30.1", "78.2")], "Hotel string, Latitude string, lng string")
    assert places.validate_locations(good).first()["property_id"] == "A"
    known = spark.createDataFrame([("B",)], "property_id string")
    for bad in (good.withColumn("Latitude", F.lit("91")), good.withColumn("lng", F.lit("-181")),
                good.withColumn("lng", F.lit("x")), good.unionByName(good)):
        with pytest.raises(src.SchemaError):
            places.validate_locations(bad)
    with pytest.raises(src.SchemaError, match="not in the reviews"):
        places.validate_locations(good, known)


def test_region_files(spark, tmp_path):
    head = "location,name,user_profile,userloc,review,rating"
    write(tmp_path / "Hill_Inn-Mussoorie_Dehradun_District_Uttarakhand.csv",
          ["x,n,p,l,Lovely stay,50", "x,n,p,l,Awful room,10", "x,n,p,l,lovely  STAY,40"], head)
    write(tmp_path / "Plain_Inn-Haridwar_Haridwar_District_Uttarakhand.csv",
          ["x,n,p,l,Good,40"], head)
    raw = region.read_hotel_files(spark, str(tmp_path))
    rows = region.prepare_region(raw)
    got = {r["text"]: r for r in rows.collect()}
    assert {t: r["label"] for t, r in got.items()} == {"Lovely stay": 1, "Awful room": -1}
    assert got["Awful room"]["town"] == "Mussoorie" and got["Awful room"]["hotel"][0] == "H"
    report = region.region_report(raw, rows).first()
    assert (report["rows_read"], report["rows_after_hill_filter"], report["rows_after_dedup"]) == (
        4, 3, 2)


def test_load_cluster_and_snapshot(spark, tmp_path):
    folder = tmp_path / "synthetic_reviews"
    folder.mkdir()
    write(folder / "a.csv", ROWS)
    cluster = load_cluster(spark, str(folder))
    assert cluster.is_synthetic and cluster.source_name == "synthetic_reviews"
    assert {r["property_id"] for r in cluster.list_properties().collect()} == {
        "Property A", "Property B"}
    assert cluster.search_reviews(query="GREAT").count() == 3
    assert cluster.search_reviews(sentiment=-1, end="2024-02-10").count() >= 1
    with pytest.raises(ValueError):
        cluster.trend("Property Z")
    with pytest.raises(ValueError):
        cluster.intervention_check("Property A", "Food", "2030-01")
    sinks.write_snapshot({"mentions": cluster.mentions}, str(tmp_path / "out"))
    back = sinks.read_snapshot(spark, str(tmp_path / "out"), "mentions")
    assert back.count() == cluster.mentions.count()


def test_a_folder_of_part_files_is_one_export(spark, tmp_path):
    rows = [("A", "web", "2024-01-05", "5", "same text", "en", "c1")] * 2 + [("B", "web", "2024-01-06", "4", "other", "en", "c2")]
    frame = spark.createDataFrame(rows, "property_id string, platform string, date string, rating string, text string, language_hint string, cluster_id string")
    for parts in (1, 3):
        folder = f"{tmp_path}/export-{parts}"
        frame.repartition(parts).write.option("header", True).csv(folder)
        assert len(src.list_files(spark, folder)) == 1
        assert src.load_dir(spark, folder).count() == 3
        assert src.load_dir(spark, folder, multiline=False).count() == 3
    frame.coalesce(1).write.option("header", True).csv(f"{tmp_path}/many/one.csv")
    frame.coalesce(1).write.option("header", True).csv(f"{tmp_path}/many/two.csv")
    dropped = Observation("dropped")
    assert src.load_dir(spark, f"{tmp_path}/many", dropped=dropped).count() == 3
    assert dropped.get == {"rows": 6, "repeats": 3}
    from innsight.plans.cluster import load_cluster

    assert "cluster_id" in load_cluster(spark, f"{tmp_path}/many").reviews.columns


def test_exports_by_their_own_rules(spark, tmp_path):
    head = "property_id,platform,date,rating,text,language_hint\n"
    (tmp_path / "a.csv").write_text(head + 'A,x,2024-02-03,4,"one, two",en\nB,x,2024-02-04,5,same,en\n')
    (tmp_path / "b.csv").write_text("text,rating,Email,date,language_hint,platform,property_id\nthree,1,me@x.org,25/12/2023,en,y,C\nfour,2,me@x.org,01/02/2024,en,y,C\n")
    (tmp_path / "c.csv").write_text(head + "B,x,2024-02-04,5.0,same,en\nB,x,2024-02-04,5,same,en\n")
    (tmp_path / "d.jsonl").write_text('{"property_id": "D", "platform": "z", "date": 1706745600, "rating": 3, "text": "five", "language_hint": "en"}\n')
    (tmp_path / "e.csv").write_text("")
    rows = src.load_dir(spark, str(tmp_path))
    got = sorted((r["property_id"], str(r["date"]), r["rating"], r["text"]) for r in rows.collect())
    assert got == [
        ("A", "2024-02-03 00:00:00", 4.0, "one, two"), ("B", "2024-02-04 00:00:00", 5.0, "same"), ("C", "2023-12-25 00:00:00", 1.0, "three"),
        ("C", "2024-02-01 00:00:00", 2.0, "four"), ("D", "2024-02-01 05:30:00", 3.0, "five")]
    assert "Email" not in rows.columns and not [c for c in rows.columns if c.startswith("_")]


def test_faults_of_all_exports_in_one_message(spark, tmp_path):
    head = "property_id,platform,date,rating,text,language_hint\n"
    (tmp_path / "a.csv").write_text(head + "A,x,2024-02-03,9,one,en\n")
    (tmp_path / "b.csv").write_text(head + "A,x,2024-02-03,4,ok,en\nA,x,03/02/2024,4,,en\n")
    with pytest.raises(src.SchemaError, match=r"a\.csv: .*out of range: 1.*b\.csv: .*empty text: 1.*'03/02/2024' does not match '2024-02-03'"):
        src.load_dir(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text("property_id,date\n1,2\n")
    with pytest.raises(src.SchemaError, match="no column for required platform"):
        src.load_dir(spark, str(tmp_path))


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    head = "property_id,platform,date,rating,text,language_hint\n"
    for n in (2, 12):
        (tmp_path / str(n)).mkdir()
        for i in range(n):
            (tmp_path / str(n) / f"{i}.csv").write_text(head + f"A,x,2024-02-03,4,text {i},en\n")
    jobs = []
    for n in (2, 12):
        spark.sparkContext.setJobGroup(f"load-{n}", "")
        assert src.load_dir(spark, str(tmp_path / str(n))).count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"load-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_a_snapshot_is_published_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "snap")
    rows = spark.createDataFrame([("A", "2024-01-01", None if i == 3 else float(i)) for i in range(20)] + [("B", "2024-03-01", float("nan"))],
                                 "property_id string, date string, rating double").withColumn("date", F.to_date("date"))
    sinks.write_snapshot({"reviews": rows, "other": rows.limit(2)}, folder, {"source_name": "s"}, rows_per_file=6)
    found = sinks.manifest(spark, folder)
    assert found["meta"] == {"source_name": "s", "n_reviews": 21, "date_min": "2024-01-01", "date_max": "2024-03-01"}
    assert {k: v["rows"] for k, v in found["tables"].items()} == {"reviews": 21, "other": 2}
    back = sinks.read_snapshot(spark, folder, "reviews")
    assert back.schema == rows.schema and back.where("rating IS NULL").count() == 2
    sizes = back.groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in sizes) <= 6

    broken = rows.withColumn("rating", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_snapshot({"reviews": rows.limit(1), "other": broken}, folder)
    assert sinks.manifest(spark, folder) == found and sinks.read_snapshot(spark, folder, "reviews").count() == 21
    sinks.write_snapshot({"reviews": rows.limit(1)}, folder)
    assert sinks.read_snapshot(spark, folder, "reviews").count() == 1
