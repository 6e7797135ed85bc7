"""Row types of the alert jobs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

ANTARES_MESSAGE = "alerts array<struct<properties: struct<lsst_diaObject_diaObjectId: bigint, lsst_diaObject_ra: double, lsst_diaObject_dec: double, lsst_diaSource_diaSourceId: bigint, lsst_diaSource_reliability: double, ant_time_received: double>>>, locus_id string"
LASAIR_MESSAGE = "diaObjectId bigint, firstDiaSourceMjdTai double, ra double, decl double"
PITTGOOGLE_MESSAGE = "diaObject struct<diaObjectId: bigint, ra: double, dec: double>, diaSource struct<diaSourceId: bigint, reliability: double, midpointMjdTai: double, midPointTai: double>"
#: Numbers only: strings and bare tokens such as NaN are null. All message parsing uses these options.
JSON_OPTIONS = {"allowNonNumericNumbers": "false"}


@dataclass(frozen=True)
class CatalogSpec:
    """Where a sky catalog is and what its columns are called."""

    name: str
    root: str
    source_id_column: str
    ra_column: str
    dec_column: str
    payload_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    flag_columns: tuple[str, ...] = ()


# Names, locations, id and position columns, payload columns by keyword and standard flags of the four surveys.
GAIA = CatalogSpec(
    "gaia_dr3", "s3://stpubdata/gaia/gaia_dr3/public/hats", "source_id", "ra", "dec",
    {
        "brightness": ("phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag"),
        "location": ("ra", "dec", "parallax", "pmra", "pmdec", "ref_epoch"),
        "classification": ("classprob_dsc_combmod_star", "classprob_dsc_combmod_galaxy", "classprob_dsc_combmod_quasar"),
        "psf": ("astrometric_excess_noise", "ruwe"),
    },
)
DES = CatalogSpec(
    "des_y6_gold", "https://data.lsdb.io/hats/des/des_y6_gold", "COADD_OBJECT_ID", "RA", "DEC",
    {
        "brightness": ("MAG_AUTO_G", "MAG_AUTO_R", "MAG_AUTO_I", "MAG_AUTO_Z", "MAG_AUTO_Y"),
        "location": ("RA", "DEC", "EBV_SFD98"),
        "shape": ("BDF_T", "BDF_G_1", "BDF_G_2", "BDF_FRACDEV"),
        "redshift": ("DNF_Z", "DNF_ZSIGMA"),
        "classification": ("EXT_MASH",),
        "psf": ("WAVG_MAG_PSF_G", "WAVG_MAG_PSF_R", "WAVG_MAG_PSF_I", "WAVG_MAG_PSF_Z", "WAVG_MAG_PSF_Y"),
    },
    ("FLAGS_GOLD", "FLAGS_FOREGROUND", "FLAGS_FOOTPRINT", "BDF_FLAGS", "IMAFLAGS_ISO_G", "IMAFLAGS_ISO_R", "IMAFLAGS_ISO_I", "IMAFLAGS_ISO_Z", "IMAFLAGS_ISO_Y"),
)
DELVE = CatalogSpec(
    "delve_dr3_gold", "https://data.lsdb.io/hats/delve/delve_dr3_gold", "COADD_OBJECT_ID", "RA", "DEC",
    {
        "brightness": ("MAG_AUTO_G", "MAG_AUTO_R", "MAG_AUTO_I", "MAG_AUTO_Z"),
        "location": ("RA", "DEC", "EBV_SFD98"),
        "shape": ("BDF_T", "BDF_G_1", "BDF_G_2", "BDF_FRACDEV"),
        "redshift": ("DNF_Z", "DNF_ZSIGMA"),
        "classification": ("EXT_MASH",),
        "psf": ("WAVG_MAG_PSF_G", "WAVG_MAG_PSF_R", "WAVG_MAG_PSF_I", "WAVG_MAG_PSF_Z"),
    },
    ("FLAGS_GOLD", "FLAGS_FOREGROUND", "FLAGS_FOOTPRINT", "BDF_FLAGS", "IMAFLAGS_ISO_G", "IMAFLAGS_ISO_R", "IMAFLAGS_ISO_I", "IMAFLAGS_ISO_Z"),
)
SKYMAPPER = CatalogSpec(
    "skymapper_dr4", "https://data.lsdb.io/hats/skymapper_dr4/catalog", "object_id", "raj2000", "dej2000",
    {
        "brightness": ("u_psf", "v_psf", "g_psf", "r_psf", "i_psf", "z_psf"),
        "location": ("raj2000", "dej2000", "e_raj2000", "e_dej2000"),
        "classification": ("class_star",),
        "psf": ("u_psf", "v_psf", "g_psf", "r_psf", "i_psf", "z_psf", "chi2_psf", "flags_psf"),
    },
    ("flags", "nimaflags", "ngood"),
)


def survey_catalogs(base: str | None = None, roots: dict[str, str] | None = None) -> list[CatalogSpec]:
    """The four sky catalogs that alerts are matched with, where their surveys publish them; base: below one folder or bucket instead; roots: locations of some by name, over both."""
    catalogs = [GAIA, DES, DELVE, SKYMAPPER]
    at = {c.name: f"{base.rstrip('/')}/{c.name}" if base else c.root for c in catalogs} | (roots or {})
    return [replace(c, root=at[c.name]) for c in catalogs]
