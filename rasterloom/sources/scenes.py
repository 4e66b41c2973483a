"""Scenes by name or by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.scene import crop, scene_from_vectors
from rasterloom.sources.envi import load_cube, read_header
from rasterloom.sources.matlab import load_matlab

# Names of public scenes, their files below the data folder and the arrays in them (None: the only one).
ENVI_SCENES = {
    "whu_hi_honghu": "WHU-Hi-HongHu/WHU-Hi-HongHu",
    "whu_hi_longkou": "WHU-Hi-LongKou/WHU-Hi-LongKou",
    "whu_hi_hanchuan": "WHU-Hi-HanChuan/WHU-Hi-HanChuan",
}
MATLAB_SCENES = {
    "salinas_a": ("SalinasA_corrected.mat", "salinasA_corrected", "SalinasA_gt.mat", "salinasA_gt"),
    "salinas": ("Salinas_corrected.mat", "salinas_corrected", "Salinas_gt.mat", "salinas_gt"),
    "indian_pines": ("Indian_pines_corrected.mat", "indian_pines_corrected", "Indian_pines_gt.mat", "indian_pines_gt"),
    "pavia_university": ("PaviaU.mat", "paviaU", "PaviaU_gt.mat", "paviaU_gt"),
    "ksc": ("KSC/KSC_data.mat", None, "KSC/KSC_gt.mat", None),
    "botswana": ("Botswana/Botswana_data.mat", None, "Botswana/Botswana_gt.mat", None),
    "houston13": ("Houston13/houston13_data.mat", None, "Houston13/houston13_gt.mat", None),
    "trento": ("TrentoRepo/Italy_hsi.mat", "data", "TrentoRepo/allgrd.mat", "mask_test"),
}

# Class names of a public scene, in the order of their numbers.
CLASS_NAMES = {
    "whu_hi_honghu": (
        "Unclassified", "Red roof", "Road", "Bare soil", "Cotton", "Cotton firewood", "Rape", "Chinese cabbage", "Pakchoi", "Cabbage", "Tuber mustard", "Brassica parachinensis", "Brassica chinensis",
        "Small Brassica chinensis", "Lactuca sativa", "Celtuce", "Film covered lettuce", "Romaine lettuce", "Carrot", "White radish", "Garlic sprout", "Broad bean", "Tree",
    ),
}


def load_vectors(spark: SparkSession, path: str, labels: bool = True) -> DataFrame:
    return scene_from_vectors(spark.read.parquet(path), label="label" if labels else None)


def load_table(spark: SparkSession, path: str, labels: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return df if labels else df.drop("gt")


def load_envi(spark: SparkSession, header: str, cube: str, truth_header: str | None = None, truth: str | None = None, rows: int = 64, labels: bool = True) -> DataFrame:
    """S3: a cube, with the first band of its reference raster as gt if that is given and labels are wanted."""
    df = load_cube(spark, header, cube, rows)
    if truth is None or not labels:
        return df
    facts, other = read_header(spark, header), read_header(spark, truth_header)
    if (facts["lines"], facts["samples"]) != (other["lines"], other["samples"]):
        raise ValueError("the cube and its reference labels differ in size")
    return df.join(load_cube(spark, truth_header, truth, rows).select("i", F.get("v", F.lit(0)).cast("int").alias("gt")), "i")


def load_mat(spark: SparkSession, cube: str, key: str | None = None, truth: str | None = None, truth_key: str | None = None, shape: tuple[int, int] | None = None, labels: bool = True) -> DataFrame:
    """Without labels the reference file is never opened, and the shape tells the axes."""
    return load_matlab(spark, cube, key, truth if labels else None, truth_key, shape)


#: Loaders by kind; a further kind is a further entry. Each takes (spark, labels=, **where) and gives (i, y, x, v[, gt]).
LOADERS: dict[str, Callable[..., DataFrame]] = {"vectors": load_vectors, "table": load_table, "envi": load_envi, "matlab": load_mat}


def _located(kind: str, where: dict) -> tuple[str, dict]:
    """The loader of a public scene by name and where its files lie below data_dir; any other kind as it is."""
    where = dict(where)
    if kind in ENVI_SCENES:
        base = f"{where.pop('data_dir')}/{ENVI_SCENES[kind]}"
        return "envi", {"header": f"{base}.hdr", "cube": f"{base}.bsq", "truth_header": f"{base}_gt.hdr", "truth": f"{base}_gt.bsq", **where}
    if kind in MATLAB_SCENES:
        folder = where.pop("data_dir")
        cube, key, truth, truth_key = MATLAB_SCENES[kind]
        return "matlab", {"cube": f"{folder}/{cube}", "key": key, "truth": f"{folder}/{truth}", "truth_key": truth_key, **where}
    if kind not in LOADERS:
        raise ValueError(f"unknown scene {kind}; there are {', '.join([*LOADERS, *ENVI_SCENES, *MATLAB_SCENES])}")
    return kind, where


def load_scene(spark: SparkSession, kind: str, *, subsample: int | None = None, labels: bool = True, **where) -> DataFrame:
    """A scene by kind, or by the name of a public scene whose files lie below data_dir; without labels nothing of the reference is read."""
    loader, where = _located(kind, where)
    df = LOADERS[loader](spark, labels=labels, **where)
    return crop(df, subsample) if subsample else df


def scene_facts(pixels: DataFrame, name: str, header: dict[str, str] | None = None) -> DataFrame:
    """One row (scene, height, width, bands, pixels, wavelengths, class_names) about pixels (i, y, x, v[, gt]).

    wavelengths are the header's if it has one for each band, else the bands' numbers from 0. class_names are those of a
    public scene that has names, else the numbers from 0 to the largest label as text; null without labels. A scene
    without pixels has no height, width or bands, and no wavelengths.
    """
    given = [float(x) for x in (header or {}).get("wavelength", "").split(",") if x.strip()]
    top = F.max("gt").cast("int") if "gt" in pixels.columns else F.lit(None).cast("int")
    one = pixels.agg(
        (F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"), F.max(F.size("v")).cast("long").alias("bands"), F.count("*").alias("pixels"), top.alias("_top")
    )
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1), lambda b: b.cast("float"))
    wavelengths = F.when(F.col("bands") == len(given), F.array(*map(F.lit, given)).cast("array<float>")).when(F.col("bands") > 0, numbers) if given else F.when(F.col("bands") > 0, numbers)
    numbered = F.when(F.col("_top") >= 0, F.transform(F.sequence(F.lit(0), F.col("_top")), lambda c: c.cast("string")))
    names = F.when(F.col("_top").isNotNull(), F.array(*map(F.lit, CLASS_NAMES[name]))) if name in CLASS_NAMES else numbered
    return one.select(F.lit(name).alias("scene"), "height", "width", "bands", "pixels", wavelengths.alias("wavelengths"), names.alias("class_names"))


def load_scene_facts(spark: SparkSession, kind: str, *, subsample: int | None = None, labels: bool = True, **where) -> DataFrame:
    """The facts of a scene that load_scene would read, with the wavelengths of its header if it has one."""
    loader, located = _located(kind, where)
    header = read_header(spark, located["header"]) if loader == "envi" else None
    return scene_facts(load_scene(spark, kind, subsample=subsample, labels=labels, **where), kind, header)
