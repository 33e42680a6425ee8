"""All parameters of the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # sources
    extensions: tuple[str, ...] = (".tif", ".tiff", ".svs", ".ndpi", ".mrxs")
    fallback_mpp: float = 0.25
    overwrite: bool = False
    # windows and resolution
    target_mpp: float = 0.25
    roi_px: int = 2048
    stride_px: int = 2048
    max_windows: int | None = None
    # inference
    patch: int = 256
    patch_stride: int = 192
    batch_tiles: int = 32
    classes: int = 3
    object_threshold: float = 0.5
    # foreground filter
    thumbnail_max: int = 3000
    open_close: int = 5
    use_eroded: bool = True
    erosion: int = 5
    erosion_rounds: int = 1
    min_component_share: float = 0.0005
    min_tissue: float = 0.60
    min_center_tissue: float = 0.50
    grid: int = 4
    min_cell_tissue: float = 0.25
    min_cells: int = 6
    min_saturation: float = 15.0
    max_value: float = 250.0
    # selection
    direct_score: float = 0.80
    waiting_score: float = 0.45
    direct_min_stroma: float = 0.10
    direct_min_tumor: float = 0.01
    direct_min_interface: float = 0.0003
    waiting_min_stroma: float = 0.30
    waiting_max_tumor: float = 0.01
    neighbor_min_tumor: float = 0.03
    neighbor_min_interface: float = 0.0003
    radius_um: float = 150.0
    weight_peritumoral: float = 0.40
    weight_stroma: float = 0.25
    weight_interface: float = 0.20
    weight_tissue: float = 0.10
    weight_balance: float = 0.05
    interface_scale: float = 0.01
    # object score
    object_diameter_um: float = 8.0
    max_score: float = 0.90
    min_object_px: int = 5
    max_object_px: int | None = None
    open_objects: int = 0
    split_touching: bool = True
    split_at: float = 0.35
    split_rounds: int = 2
    # exports
    save_images: bool = True
    save_masks: bool = True
    save_overlays: bool = True


PARAMS = Params()
