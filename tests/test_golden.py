"""The published report follows from the published confusion matrix."""

from loadsig.operators.classify import classification_report, confusion_matrix

# Actual rows by predicted columns, and the two-digit report.
MATRIX = [[24, 1, 1], [1, 10, 2], [3, 5, 18]]
REPORT = {
    "0": (0.86, 0.92, 0.89, 26.0),
    "1": (0.62, 0.77, 0.69, 13.0),
    "2": (0.86, 0.69, 0.77, 26.0),
    "accuracy": (0.8, 0.8, 0.8, 0.8),
    "macro avg": (0.78, 0.79, 0.78, 65.0),
    "weighted avg": (0.81, 0.8, 0.8, 65.0),
}


def cells(spark):
    rows = [("A", a, p, n) for a, line in enumerate(MATRIX) for p, n in enumerate(line)]
    return spark.createDataFrame(rows, "building_id string, actual int, predicted int, n bigint")


def test_report(spark):
    got = {r["label"]: (r["precision"], r["recall"], r["f1_score"], r["support"])
           for r in classification_report(cells(spark)).collect()}
    assert got == REPORT


def test_matrix_keeps_absent_classes(spark):
    rows = confusion_matrix(cells(spark).filter("actual <> 1"), [0, 1, 2]).orderBy("actual").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 24, 1, 1), (1, 0, 0, 0), (2, 3, 5, 18)]
