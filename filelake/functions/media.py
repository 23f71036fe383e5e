"""Media and EXIF metadata tables to JSON columns."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names of video and audio metadata.
VIDEO_FIELDS = ["width", "height", "duration_ms", "frame_rate", "codec", "format"]
AUDIO_TAGS = ["artist", "album", "album_artist", "title", "track", "year", "duration_s", "genre", "bitrate_kbps"]

# Names of TIFF and EXIF tags by number.
EXIF_TAGS = {
    11: "ProcessingSoftware", 254: "NewSubfileType", 255: "SubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample",
    259: "Compression", 262: "PhotometricInterpretation", 263: "Thresholding", 264: "CellWidth", 265: "CellLength", 266: "FillOrder",
    269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation",
    277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 280: "MinSampleValue", 281: "MaxSampleValue",
    282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 285: "PageName", 288: "FreeOffsets", 289: "FreeByteCounts",
    290: "GrayResponseUnit", 291: "GrayResponseCurve", 292: "T4Options", 293: "T6Options", 296: "ResolutionUnit", 297: "PageNumber",
    301: "TransferFunction", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 317: "Predictor", 318: "WhitePoint",
    319: "PrimaryChromaticities", 320: "ColorMap", 321: "HalftoneHints", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets",
    325: "TileByteCounts", 330: "SubIFDs", 332: "InkSet", 333: "InkNames", 334: "NumberOfInks", 336: "DotRange", 337: "TargetPrinter",
    338: "ExtraSamples", 339: "SampleFormat", 340: "SMinSampleValue", 341: "SMaxSampleValue", 342: "TransferRange", 343: "ClipPath",
    344: "XClipPathUnits", 345: "YClipPathUnits", 346: "Indexed", 347: "JPEGTables", 351: "OPIProxy", 512: "JPEGProc",
    513: "JpegIFOffset", 514: "JpegIFByteCount", 515: "JpegRestartInterval", 517: "JpegLosslessPredictors", 518: "JpegPointTransforms",
    519: "JpegQTables", 520: "JpegDCTables", 521: "JpegACTables", 529: "YCbCrCoefficients", 530: "YCbCrSubSampling",
    531: "YCbCrPositioning", 532: "ReferenceBlackWhite", 700: "XMLPacket", 18246: "Rating", 18249: "RatingPercent", 33421: "CFARepeatPatternDim",
    33422: "CFAPattern", 33423: "BatteryLevel", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 33723: "IPTCNAA",
    34377: "ImageResources", 34665: "ExifOffset", 34675: "InterColorProfile", 34850: "ExposureProgram", 34852: "SpectralSensitivity",
    34853: "GPSInfo", 34855: "ISOSpeedRatings", 34856: "OECF", 34864: "SensitivityType", 34865: "StandardOutputSensitivity",
    34866: "RecommendedExposureIndex", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 36880: "OffsetTime",
    36881: "OffsetTimeOriginal", 36882: "OffsetTimeDigitized", 37121: "ComponentsConfiguration", 37122: "CompressedBitsPerPixel",
    37377: "ShutterSpeedValue", 37378: "ApertureValue", 37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue",
    37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength", 37396: "SubjectLocation",
    37500: "MakerNote", 37510: "UserComment", 37520: "SubsecTime", 37521: "SubsecTimeOriginal", 37522: "SubsecTimeDigitized",
    40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject", 40960: "FlashPixVersion",
    40961: "ColorSpace", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 40964: "RelatedSoundFile", 40965: "ExifInteroperabilityOffset",
    41483: "FlashEnergy", 41486: "FocalPlaneXResolution", 41487: "FocalPlaneYResolution", 41488: "FocalPlaneResolutionUnit",
    41493: "ExposureIndex", 41495: "SensingMethod", 41728: "FileSource", 41729: "SceneType", 41985: "CustomRendered",
    41986: "ExposureMode", 41987: "WhiteBalance", 41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType",
    41991: "GainControl", 41992: "Contrast", 41993: "Saturation", 41994: "Sharpness", 41995: "DeviceSettingDescription",
    41996: "SubjectDistanceRange", 42016: "ImageUniqueID", 42032: "CameraOwnerName", 42033: "BodySerialNumber", 42034: "LensSpecification",
    42035: "LensMake", 42036: "LensModel", 42037: "LensSerialNumber", 42240: "Gamma",
}


def _first(tracks_type: str, fields: list[str]) -> Column:
    """First track of a type per file, by track number."""
    order = F.when(F.col("track_type") == tracks_type, F.col("track_no"))
    return F.min_by(F.when(F.col("track_type") == tracks_type, F.struct(*fields)), order)


def video_metadata(tracks: DataFrame) -> DataFrame:
    """One row per file with a video track: its first video track and the first audio format."""
    firsts = tracks.groupBy("path").agg(
        _first("Video", VIDEO_FIELDS).alias("v"), _first("Audio", ["format"]).alias("a")
    )
    return firsts.where("v is not null").select("path", "v.*", F.col("a.format").alias("audio_codec"))


def video_json(videos: DataFrame) -> DataFrame:
    """``exif_data`` of videos keeps fields without a value."""
    fields = F.struct(*VIDEO_FIELDS, "audio_codec")
    return videos.select("path", F.to_json(fields, {"ignoreNullFields": "false"}).alias("exif_data"))


def audio_metadata(tags: DataFrame) -> DataFrame:
    """One row per audio file of ``(path, field, value, seq)`` rows: the first value of every field, fields by name.

    A field without a value is NULL; a file without any has no row.
    """
    known = tags.where(F.col("field").isin(AUDIO_TAGS) & F.col("value").isNotNull())
    firsts = [F.min_by(F.when(F.col("field") == n, F.col("value")), F.when(F.col("field") == n, F.col("seq"))).alias(n) for n in AUDIO_TAGS]
    return known.groupBy("path").agg(*firsts)


def audio_json(tags: DataFrame) -> DataFrame:
    """``exif_data`` of audio files drops fields without a value."""
    return tags.select("path", F.to_json(F.struct(*AUDIO_TAGS)).alias("exif_data"))


def exif_names(tags: DataFrame) -> DataFrame:
    """Last value per file and tag with the tag's name; a tag without a name keeps its number.

    Byte values are decoded as UTF-8 before they get here.
    """
    last = tags.groupBy("path", "tag_id").agg(F.max_by("value", "seq").alias("value"))
    names = F.create_map(*[F.lit(x) for pair in EXIF_TAGS.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, F.col("tag_id").cast("int")), F.col("tag_id").cast("string"))
    return last.select("path", name.alias("tag"), "value")


def exif_json(named: DataFrame) -> DataFrame:
    """``exif_data`` per file. Tag numbers have 16 bits, so a file's list is bounded."""
    pairs = F.array_sort(F.collect_list(F.struct("tag", "value")))
    return named.groupBy("path").agg(F.to_json(F.map_from_entries(pairs)).alias("exif_data"))


class MediaTables(NamedTuple):
    """What a parser of containers found: tables by path that a scan turns into ``exif_data``."""

    tracks: DataFrame | None = None
    audio_tags: DataFrame | None = None
    exif_tags: DataFrame | None = None


def media_json(tables: MediaTables) -> DataFrame | None:
    """``(path, exif_data)`` of all files in the tables: images by their tags, else video, else audio."""
    parts = []
    if tables.exif_tags is not None:
        parts.append(exif_json(exif_names(tables.exif_tags)).withColumn("rank", F.lit(0)))
    if tables.tracks is not None:
        parts.append(video_json(video_metadata(tables.tracks)).withColumn("rank", F.lit(1)))
    if tables.audio_tags is not None:
        parts.append(audio_json(audio_metadata(tables.audio_tags)).withColumn("rank", F.lit(2)))
    if not parts:
        return None
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("path").agg(F.min_by("exif_data", "rank").alias("exif_data"))


def exif_value(exif_data: Column, field: str, kind: str = "string") -> Column:
    """A field of ``exif_data`` as a typed value; NULL if it is missing or of another type."""
    quote = '"' if "'" in field else "'"
    if quote in field:
        raise ValueError("a field name may hold single or double quotes, not both")
    return F.try_variant_get(F.try_parse_json(exif_data), f"$[{quote}{field}{quote}]", kind)
