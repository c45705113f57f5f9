"""Schemas of the persisted tables, in the order in which their columns are written."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}
    pairs = (x.split(":") for x in text.split())
    return T.StructType([T.StructField(n, kinds[k]) for n, k in pairs])


POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
PLOTS = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("plot_id", T.StringType()), T.StructField("ring", RING), T.StructField("props", T.MapType(T.StringType(), T.StringType())), T.StructField("epsg", T.IntegerType())])
# Column names and order of the written tables.
MANIFEST = _table(
    "plot_id:s plot_area_m2:d margin_m:d raw_image:s raw_file:s crop_w:i crop_h:i corners_in_frame:i raw_covered_pct:d raw_covered_m2:d cand_frames:i best_frame:s best_cover_pct:d best_cover_m2:d "
    "frames_used:i seam_y_pct:s fit_rows:i fit_width_m:d fit_length_m:d fit_area_m2:d ortho_file:s ortho_covered_pct:d ortho_covered_m2:d source_path:s raw_style:s src_x0:i src_y0:i src_x1:i src_y1:i pixel_source:s note:s"
)
CANDIDATES = _table("plot_id:s rank:i camera:s cover_pct:d cover_m2:d corners_in_frame:i aniso:d mm_per_px:d used:s")
REFIT_AUDIT = _table("plot_id:s plot_w_mm:d n_all:i n_in:i gap_med_mm:d block_span_mm:d block_gap_err_mm:d offset_mm:d global_mm:d resid_mm:d shift_mm:d action:s flag:s rows_mm:s")
TILE_INDEX = _table(
    "tile:s rel_path:s plot_stem:s col:i row:i x0:i y0:i w:i h:i out_px:s out_w:i out_h:i turned_90:b src_mm_px:d tile_mm_px:d ground_mm:d tile_m:d tile_across_m:d resampled:b band_lo:i band_hi:i across_axis:i "
    "src_w:i src_h:i veg_pct:d src:s bits:i src_bits:i georef:s"
)
ROWS_REPORT = _table(
    "plot_stem:s src:s ok:b reason:s rows_found:i rows_present:i pitch_px:d pitch_mm:d angle_deg:d middle_rows:s band_lo:i band_hi:i band_mm:d tile_across_mm:d rows_covered:d plot_len_m:d end_trim:s usable_lo:i usable_hi:i usable_len_m:d "
    "tiles_fit:i tiles_in_band:i tiles_drawn:i rows_saved:i veg_mode:s"
)
CROP_ROWS = T.StructType([*_table("Plot_ID:s row_idx:i v_off_m:d length_m:d angle_deg:d source:s contrast:d").fields, T.StructField("line", RING)])
ROWS_INDEX = _table("file:s plot_stem:s row:i of_rows:i middle:b present:b contrast:d centre_px:d width_px:d angle_deg:d x0:i y0:i w:i h:i across_axis:i turned_90:b rel_path:s")
CONVERSION_LOG = _table("iiq:s output:s ok:b width:i height:i bits:i error:s georef:s")
QA_FLAGS = _table("plot:s flags:s")
