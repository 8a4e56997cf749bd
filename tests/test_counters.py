"""What a project still lacks, counted on a hand-made project and on an empty one."""

from depthlake.operators import reports as R

PHOTOS = "photo long, confirmed boolean, top_cm long, base_cm long, source string"
MATCHES = "photo long, layer_id long, overlap_top_cm long, overlap_base_cm long, described boolean"


def counted(spark, photos, columns, layers, matches, annotations):
    rows = R.coverage_counters(
        spark.createDataFrame(photos, PHOTOS), spark.createDataFrame(columns, "photo long, verified boolean"), spark.createDataFrame(layers, "layer_id long"),
        spark.createDataFrame(matches, MATCHES), spark.createDataFrame(annotations, "photo long, label string, target_text string"), sequenced=("ordered",)).collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_a_project_with_open_ground(spark):
    photos = [(1, True, 0, 100, "ordered"), (2, True, 100, 200, "manual"), (3, False, 0, 50, None), (4, True, None, None, "ordered")]
    columns = [(1, True), (1, False), (2, None)]
    matches = [(1, 10, 0, 40, True), (1, 11, 60, 100, True), (1, 11, 60, 100, True), (1, 12, 30, 60, False)]
    notes = [(1, "b", "seen"), (1, "B", " "), (1, "a", None), (2, "a", "seen")]
    assert counted(spark, photos, columns, [(10,), (11,), (12,), (13,)], matches, notes) == {
        "photos_without_core_columns": 2, "verified_column_photos": 1, "photos_with_labels": 1, "photos_without_labels": 3,
        "photos_without_masks": 2, "sequenced_photos": 2, "layers_without_photo": 1, "annotation_text_targets": 2, "classes": "a,B,b",
        "open_label_gaps": 1, "open_description_gaps": 2}  # photo 2 is open as a whole, twice


def test_an_empty_project(spark):
    got = counted(spark, [], [], [], [], [])
    assert got.pop("classes") == "" and set(got.values()) == {0}
