"""Fixed values of the data model: names, codes, default lists and limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grain:
    """One pre-aggregated traffic table."""

    name: str
    table: str
    key: str
    measure: str
    month_pattern: str = "yyyy-MM"


# --- fixed values -----------------------------------------------------------
# Table, key column and measure per grain.
JOURS = Grain("jours", "g_mdp_trafics_jour_actualise", "da_comptage", "trafic_reel")
SEMAINES = Grain(
    "semaines", "g_mdp_trafics_semaine_actualise", "co_semaine_comptage", "nb_objet_retenu"
)
MOIS = Grain("mois", "g_mdp_trafics_mois_actualise", "co_mois_comptage", "nb_objet_retenu")
GRAINS = {g.name: g for g in (JOURS, SEMAINES, MOIS)}

DEFAULT_CATALOG = "gold"
DEFAULT_SCHEMA = "default"

# Descriptive columns shared by the three grains.
DESCRIPTIVE_COLUMNS = [
    "co_niveau_regroupement_operationnel",
    "co_regate",
    "lb_entite",
    "co_comptage",
    "lb_comptage",
    "co_objet",
    "lb_objet",
    "co_type_objet",
    "lb_type_objet",
]

SITE_LEVEL = "SITE"

# The nine count codes kept by the filtered traffic queries.
COUNT_CODES = [
    "TLOP1", "ULOAD", "TRSP1", "OR4PM", "OR4PX",
    "TI_COL_MENAGE", "TI_COL_CEDEX", "IMPJ", "VQQP0",
]

AUTO_MODE = "auto"
FIXED_MODES = ["jours", "semaines", "mois"]
MAX_SPAN_DAYS = 730

# Default lists of a scenario page.
DEFAULT_TYPES = [
    (1, "VL", "Véhicules légers"),
    (2, "PL", "Poids lourds"),
    (3, "2RM", "Deux-roues motorisés"),
    (4, "TC", "Transports en commun"),
    (5, "VELO", "Vélos"),
    (6, "PIET", "Piétons"),
]
DEFAULT_PRODUCTS = [
    (1, "P01", "Produit 01", False),
    (2, "P02", "Produit 02", False),
    (3, "P03", "Produit 03", False),
    (4, "P04", "Produit 04", False),
    (5, "P05", "Produit 05", False),
]

DRAFT_STATUS = "Brouillon"

# Bounds of a scenario period and its longest span.
PERIOD_MIN = "2015-01-01"
PERIOD_MAX = "2031-12-31"
MAX_PERIOD_YEARS = 2

# Row counts accepted by a table sample.
SAMPLE_MIN = 1
SAMPLE_MAX = 100
SAMPLE_DEFAULT = 10
