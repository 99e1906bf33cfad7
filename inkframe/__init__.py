"""Image-region and pixel data, and training text, on Spark.

The names below are loaded when they are first used.
"""

from importlib import import_module

_WHERE = {
    "sources.images": ("list_images", "read_images", "read_masks", "to_pixels", "from_pixels", "encode_png", "output_names"),
    "sources.png_files": ("write_files",),
    "operators.models": ("detect", "detect_all", "pick_device", "status", "reset"),
    "operators.consensus": ("consensus", "overlap_pairs"),
    "operators.filters": ("prepare", "edges", "contrast_table", "edges_table"),
    "operators.search": ("find_text_colors", "exhaustive_search"),
    "operators.tfidf": ("text_mask", "cluster_scores", "score_map", "top_colors"),
    "operators.morphology": ("clean", "close", "expand", "smooth"),
    "operators.tiles": ("by_tiles",),
    "operators.components": ("label", "anchored"),
    "operators.colors": ("mask_exact", "mask_near", "mask_near_table", "ocr_image"),
    "operators.ranks": ("percentiles",),
    "operators.inpaint": ("telea", "telea_by_hole", "fill_by_model", "combine_masks"),
    "plans.cascade": ("detected_regions", "regions_of", "masks_of", "repair"),
    "plans.__main__": ("main", "set_up_logging"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(name)
    return getattr(import_module(f"inkframe.{_MODULE[name]}"), name)
