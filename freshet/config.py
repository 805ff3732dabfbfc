"""Configuration of a model run (V2, V3, V5)."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

#: Option defaults of a command-line run (fixed values). The control-point and flow files have none and must be named.
DEFAULTS = {
    "flowline_source": "Shape",
    "flowline_layer": None,
    "vaa_file": "Shape/NHDFlowlineVAA.dbf",
    "basin_shp": "river_basin/TWDB_MRBs_2014.shp",
    "basin_name_field": "basin_name",
    "basin_name_value": "Brazos",
    "cp_meta_file": None,
    "flo_file": None,
    "output_file": "modeled_monthly_comid_flows.csv",
    "output_shapefile": None,
    "shapefile_date": None,
    "start_date": "2010-01-01",
    "end_date": "2024-12-01",
    "runoff_coeff_m_per_month": 0.0008,
    "gage_crosswalk_file": None,
    "calibrate": False,
    "calibration_months": 24,
}


@dataclass
class ModelConfig:
    flowline_source: str
    flowline_layer: str | None
    vaa_file: str | None
    basin_shp: str
    basin_name_field: str
    basin_name_value: str
    cp_meta_file: str
    flo_file: str
    output_file: str
    output_shapefile: str | None = None
    shapefile_date: str | None = None
    start_date: str = DEFAULTS["start_date"]
    end_date: str = DEFAULTS["end_date"]
    runoff_coeff_m_per_month: float = DEFAULTS["runoff_coeff_m_per_month"]
    gage_crosswalk_file: str | None = None
    calibrate: bool = False
    calibration_months: int = DEFAULTS["calibration_months"]

    @classmethod
    def of(cls, **options) -> ModelConfig:
        """The defaults with `options` over them."""
        return cls(**{f.name: options.get(f.name, DEFAULTS[f.name]) for f in fields(cls)})

    @classmethod
    def for_years(cls, start_year: int, end_year: int, **options) -> ModelConfig:
        """January of the first year to December of the last; the flowline layer and the routing table default otherwise here."""
        if end_year < start_year:
            raise ValueError("the end year must not be before the start year")
        return cls.of(**({"flowline_layer": "NHDFlowline", "vaa_file": ""} | options), start_date=f"{start_year:04d}-01-01", end_date=f"{end_year:04d}-12-01")

    def validated(self) -> ModelConfig:
        """Raise for missing fields and dates that no run could use, before any file is read or written."""
        for name in ("flowline_source", "basin_shp", "basin_name_field", "basin_name_value", "cp_meta_file", "flo_file", "output_file"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        start, end = date.fromisoformat(self.start_date), date.fromisoformat(self.end_date)
        if end < start:
            raise ValueError("end_date must not be before start_date")
        if self.runoff_coeff_m_per_month <= 0:
            raise ValueError("runoff_coeff_m_per_month must be positive")
        if self.shapefile_date:
            day = date.fromisoformat(self.shapefile_date)
            if day.day != 1 or not start <= day <= end:
                raise ValueError("shapefile_date must be a month start between start_date and end_date")
        return self
