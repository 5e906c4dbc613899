"""The registered queries in DuckDB SQL, written independently of the operators.

Routing is checked by labelling every single day of every request; calendars by
listing the days; edits by ranking the log.
"""

from __future__ import annotations

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

CODES = "['TLOP1','ULOAD','TRSP1','OR4PM','OR4PX','TI_COL_MENAGE','TI_COL_CEDEX','IMPJ','VQQP0','X01','X02','X03']"
KNOWN = "('TLOP1','ULOAD','TRSP1','OR4PM','OR4PX','TI_COL_MENAGE','TI_COL_CEDEX','IMPJ','VQQP0')"
DIMS = (
    "co_niveau_regroupement_operationnel, co_regate, lb_entite, co_comptage, lb_comptage, "
    "co_objet, lb_objet, co_type_objet, lb_type_objet"
)

DIMS_J = ", ".join(f"j.{d.strip()}" for d in DIMS.split(","))

MARTS = f"""
livre AS (
  SELECT s_nationkey AS n, l_partkey % 12 AS c, CAST(l_shipdate AS DATE) AS jour,
         CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
decrit AS (
  SELECT CASE WHEN n % 5 = 0 THEN 'ZONE' ELSE 'SITE' END AS co_niveau_regroupement_operationnel,
         CAST(n AS VARCHAR) AS co_regate, 'Site ' || n AS lb_entite,
         ({CODES})[c + 1] AS co_comptage, 'Comptage ' || ({CODES})[c + 1] AS lb_comptage,
         'O' || (c % 4) AS co_objet, 'Objet O' || (c % 4) AS lb_objet,
         'T' || (c % 2) AS co_type_objet, 'Type T' || (c % 2) AS lb_type_objet, jour, q
  FROM livre
),
jours AS (
  SELECT {DIMS}, strftime(jour, '%Y-%m-%d') AS da_comptage, CAST(sum(q) AS BIGINT) AS trafic_reel
  FROM decrit GROUP BY ALL
),
semaines AS (
  SELECT {DIMS}, CAST(strftime(jour, '%G') AS INTEGER) AS co_annee_comptage,
         strftime(jour, '%G-%V') AS co_semaine_comptage,
         CAST(date_trunc('week', jour) AS DATE) AS da_lundi_semaine_comptage,
         CAST(sum(q) AS BIGINT) AS nb_objet_retenu
  FROM decrit GROUP BY ALL
),
mois AS (
  SELECT {DIMS}, CAST(year(jour) AS INTEGER) AS co_annee_comptage,
         strftime(jour, '%Y-%m') AS co_mois_comptage, CAST(sum(q) AS BIGINT) AS nb_objet_retenu
  FROM decrit GROUP BY ALL
)"""

UNITED = f"""
uni AS (
  SELECT 'jours' AS periode, {DIMS}, da_comptage, NULL::INTEGER AS co_annee_comptage,
         NULL::VARCHAR AS co_semaine_comptage, NULL::DATE AS da_lundi_semaine_comptage,
         NULL::VARCHAR AS co_mois_comptage, trafic_reel, NULL::BIGINT AS nb_objet_retenu,
         da_comptage AS cle
  FROM jours
  UNION ALL
  SELECT 'semaines', {DIMS}, NULL, co_annee_comptage, co_semaine_comptage,
         da_lundi_semaine_comptage, NULL, NULL, nb_objet_retenu, co_semaine_comptage
  FROM semaines
  UNION ALL
  SELECT 'mois', {DIMS}, NULL, co_annee_comptage, NULL, NULL, co_mois_comptage, NULL,
         nb_objet_retenu, co_mois_comptage
  FROM mois
)"""

REQUESTS = """
bornes AS (
  SELECT s_suppkey AS request_id, CAST(s_nationkey AS VARCHAR) AS co_regate,
         DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS dt_debut,
         CAST(s_suppkey * 53 % 731 AS INTEGER) AS etendue
  FROM supplier
),
demandes AS (
  SELECT request_id, co_regate, dt_debut, dt_debut + etendue AS dt_fin FROM bornes
),
journees AS (
  SELECT request_id, co_regate, dt_debut, dt_fin,
         CAST(unnest(generate_series(dt_debut, dt_fin, INTERVAL 1 DAY)) AS DATE) AS d
  FROM demandes
)"""

# A day is read from the month table if its month lies in the interval, from the
# week table if its week does and touches no such month, else from the day table.
LABELS = """
reperes AS (
  SELECT *, CAST(date_trunc('week', d) AS DATE) AS lundi,
         CAST(date_trunc('week', d) AS DATE) + 6 AS dimanche
  FROM journees
),
pleins AS (
  SELECT *,
         date_trunc('month', d) >= dt_debut AND last_day(d) <= dt_fin AS mois_plein,
         date_trunc('month', lundi) >= dt_debut AND last_day(lundi) <= dt_fin AS lundi_plein,
         date_trunc('month', dimanche) >= dt_debut AND last_day(dimanche) <= dt_fin
           AS dimanche_plein
  FROM reperes
),
etiquettes AS (
  SELECT request_id, co_regate, d,
         CASE WHEN mois_plein THEN 'mois'
              WHEN lundi >= dt_debut AND dimanche <= dt_fin
                   AND NOT lundi_plein AND NOT dimanche_plein THEN 'semaines'
              ELSE 'jours' END AS periode
  FROM pleins
),
ilots AS (
  SELECT *, d - CAST(row_number() OVER (PARTITION BY request_id, periode ORDER BY d) AS INTEGER)
              AS ilot
  FROM etiquettes
),
segments AS (
  SELECT request_id, co_regate, periode, min(d) AS seg_debut, max(d) AS seg_fin
  FROM ilots GROUP BY request_id, co_regate, periode, ilot
)"""


def _key(day: str) -> str:
    return (
        f"CASE periode WHEN 'mois' THEN strftime({day}, '%Y-%m') "
        f"WHEN 'semaines' THEN strftime({day}, '%G-%V') ELSE strftime({day}, '%Y-%m-%d') END"
    )


KEYS = f"""
cles AS (
  SELECT DISTINCT request_id, co_regate, periode, {_key('d')} AS cle FROM etiquettes
)"""

OUT = (
    f"periode, {DIMS}, da_comptage, co_annee_comptage, co_semaine_comptage, "
    "da_lundi_semaine_comptage, co_mois_comptage, trafic_reel, nb_objet_retenu"
)
ROUTED = f"""
route AS (
  SELECT k.request_id, u.*
  FROM cles k JOIN uni u
    ON u.periode = k.periode AND u.co_regate = k.co_regate AND u.cle = k.cle
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _days(alias: str) -> str:
    return f"SELECT {DIMS}, da_comptage, trafic_reel FROM jours {alias}"


RAW = """
formes AS (
  SELECT s_suppkey AS request_id, CAST(s_nationkey AS VARCHAR) AS site, s_suppkey % 11 AS k,
         DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS a,
         CAST(s_suppkey * 53 % 731 AS INTEGER) AS n
  FROM supplier
),
saisies AS (
  SELECT request_id,
         CASE k WHEN 0 THEN 'AUTO' WHEN 1 THEN 'Jours' WHEN 7 THEN 'semaines' WHEN 8 THEN 'MOIS'
                WHEN 9 THEN 'annees' WHEN 10 THEN '' END AS periode,
         CASE WHEN k <> 2 THEN site END AS co_regate,
         CASE WHEN k IN (0, 2, 3, 6, 9) THEN strftime(a, '%Y-%m-%d')
              WHEN k = 1 THEN strftime(a, '%Y%m%d')
              WHEN k = 4 THEN '20250230'
              WHEN k = 5 THEN strftime(a + n + 1, '%Y-%m-%d')
              WHEN k = 7 THEN year(a) || '-' || month(a) || '-' || day(a)
              WHEN k = 8 THEN strftime(a, '%Y%m') || day(a)
              WHEN k = 10 THEN strftime(a, '%Y-%m-') || lpad(CAST(day(a) AS VARCHAR), 2, ' ')
         END AS date_debut,
         CASE WHEN k = 3 THEN ''
              WHEN k IN (1, 8) THEN strftime(a + n, '%Y%m%d')
              WHEN k = 6 THEN strftime(a + 731, '%Y-%m-%d')
              WHEN k = 7 THEN year(a + n) || '-' || month(a + n) || '-' || day(a + n)
              ELSE strftime(a + n, '%Y-%m-%d') END AS date_fin
  FROM formes
)"""


def _parsed(text: str, dashed: bool) -> str:
    dash = "-" if dashed else ""
    pattern = rf"^(\d{{4}}){dash}(1[0-2]|0[1-9]|[1-9]){dash}(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
    part = [f"regexp_extract({text}, '{pattern}', {i})" for i in range(4)]
    iso = f"{part[1]} || '-' || lpad({part[2]}, 2, '0') || '-' || lpad(trim({part[3]}), 2, '0')"
    return (
        f"CASE WHEN {part[0]} = {text} AND {text} <> '' AND {part[1]} <> '0000' "
        f"THEN TRY_CAST({iso} AS DATE) END"
    )


def _either(text: str) -> str:
    return f"coalesce({_parsed(text, False)}, {_parsed(text, True)})"


def _judged(debut: str, fin: str, required: list[str], mode: bool = False) -> str:
    missing = ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in required)
    rule = (
        "WHEN mode NOT IN ('jours', 'semaines', 'mois', 'auto') THEN 'mode'" if mode else ""
    )
    return f"""
lues AS (
  SELECT request_id, CASE WHEN coalesce(periode, '') = '' THEN 'auto' ELSE lower(periode) END
           AS mode,
         co_regate, {debut} AS dt_debut, {fin} AS dt_fin,
         concat_ws(', ', {missing}) AS manquants
  FROM saisies
),
jugees AS (
  SELECT *, CAST(date_diff('day', dt_debut, dt_fin) AS INTEGER) AS ecart_jours,
         CASE WHEN manquants <> '' THEN 'manquant' {rule}
              WHEN dt_debut IS NULL THEN 'format_date_debut'
              WHEN dt_fin IS NULL THEN 'format_date_fin'
              WHEN dt_debut > dt_fin THEN 'ordre'
              WHEN date_diff('day', dt_debut, dt_fin) > 730 THEN 'ecart' END AS motif
  FROM lues
)"""


_ALL = ["co_regate", "date_debut", "date_fin"]
JUDGED = _judged(_either("date_debut"), _either("date_fin"), _ALL)
JUDGED_MODE = _judged(_either("date_debut"), _either("date_fin"), _ALL, mode=True)
JUDGED_CALENDAR = _judged(
    _parsed("date_debut", False), _parsed("date_fin", False), ["date_debut", "date_fin"]
)

_TYPED_DAYS = """
journees AS (
  SELECT request_id, co_regate, mode, dt_debut, dt_fin,
         CAST(unnest(generate_series(dt_debut, dt_fin, INTERVAL 1 DAY)) AS DATE) AS d
  FROM jugees WHERE motif IS NULL
)"""

COUNTS = """
sommes AS (
  SELECT l_orderkey AS scenario_id, CAST(l_partkey % 6 + 1 AS INTEGER) AS type_id,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS valeur
  FROM lineitem GROUP BY ALL
),
comptages AS (
  SELECT scenario_id,
         CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY type_id) AS INTEGER) AS id,
         type_id, valeur
  FROM sommes
)"""
TYPES = """
types(type_id, code, libelle) AS (
  VALUES (1, 'VL', 'Véhicules légers'), (2, 'PL', 'Poids lourds'),
         (3, '2RM', 'Deux-roues motorisés'), (4, 'TC', 'Transports en commun'),
         (5, 'VELO', 'Vélos'), (6, 'PIET', 'Piétons')
)"""
EDITS = """
journal0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
journal AS (
  SELECT event_id AS seq, user_id AS scenario_id,
         CASE WHEN event_type IN ('signup', 'view') THEN 'ajout'
              WHEN event_type IN ('purchase', 'click') THEN 'modification'
              ELSE 'suppression' END AS op,
         k % 7 + 1 AS id, CASE WHEN k > 4 THEN k % 8 + 1 END AS type_id,
         CASE WHEN k < 95 THEN CAST(floor(value) AS BIGINT) - 10 END AS valeur
  FROM journal0
)"""
EDITED = """
creations AS (
  SELECT j.scenario_id, j.seq, j.type_id, j.valeur,
         CAST(coalesce(m.top, 0) + row_number() OVER (PARTITION BY j.scenario_id ORDER BY j.seq)
              AS BIGINT) AS id
  FROM journal j JOIN types t ON t.type_id = j.type_id
  LEFT JOIN (SELECT scenario_id, max(id) AS top FROM comptages GROUP BY 1) m
    ON m.scenario_id = j.scenario_id
  WHERE j.op = 'ajout' AND j.valeur >= 0
),
lignes AS (
  SELECT scenario_id, id, type_id, valeur, -1 AS cree FROM comptages
  UNION ALL SELECT scenario_id, id, type_id, valeur, seq FROM creations
),
derniers AS (
  SELECT * FROM (
    SELECT scenario_id, id, seq, valeur,
           row_number() OVER (PARTITION BY scenario_id, id ORDER BY seq DESC) AS r
    FROM journal WHERE op = 'modification')
  WHERE r = 1
),
apres AS (
  SELECT l.scenario_id, l.id, l.type_id,
         CASE WHEN u.seq > l.cree THEN u.valeur ELSE l.valeur END AS valeur
  FROM lignes l LEFT JOIN derniers u ON u.scenario_id = l.scenario_id AND u.id = l.id
  WHERE NOT EXISTS (
    SELECT 1 FROM journal s WHERE s.op = 'suppression' AND s.scenario_id = l.scenario_id
      AND s.id = l.id AND s.seq > l.cree)
)"""
SCENARIOS = """
scenarios AS (
  SELECT o_orderkey AS id, CAST(o_custkey % 100 AS VARCHAR) AS site_id,
         'Scénario ' || o_orderkey AS nom, CAST(o_orderdate AS DATE) AS dateCreation,
         CASE o_orderstatus WHEN 'F' THEN 'Validé' WHEN 'O' THEN 'Brouillon'
              ELSE 'En production' END AS statut,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 15 END AS dateValidation,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 30 END AS dateMo,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 45 END AS dateProduction,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS periode_dateDebut,
         CASE WHEN o_orderstatus <> 'O'
              THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 1200 AS INTEGER) END
           AS periode_dateFin
  FROM orders
),
plages AS (
  SELECT id AS scenario_id, periode_dateDebut AS dateDebut, periode_dateFin AS dateFin
  FROM scenarios
)"""
NEW_SCENARIOS = """
noms AS (
  SELECT event_id AS seq, CAST(user_id % 100 AS VARCHAR) AS site_id,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0 THEN '   '
              ELSE '  Plan ' || event_id || ' ' END AS nom
  FROM events WHERE event_type = 'signup'
)"""
SCENARIO_COLUMNS = (
    "id, site_id, nom, dateCreation, statut, dateValidation, dateMo, dateProduction, "
    "periode_dateDebut, periode_dateFin"
)


def _shift(day: str, years: int) -> str:
    # The 1st of the shifted month plus the day of the month: 29 February rolls over.
    return (
        f"(make_date(year({day}) + {years}, month({day}), 1) + CAST(day({day}) - 1 AS INTEGER))"
    )


def _normalised(source: str, low: str, high: str, name: str) -> str:
    lo, hi = f"DATE '{low}'", f"DATE '{high}'"
    earliest = _shift("f", -2)
    return f"""
{name}_tenu AS (
  SELECT scenario_id,
         CASE WHEN dateDebut < {lo} THEN {lo} WHEN dateDebut > {hi} THEN {hi}
              ELSE dateDebut END AS a,
         CASE WHEN dateFin < {lo} THEN {lo} WHEN dateFin > {hi} THEN {hi} ELSE dateFin END AS f
  FROM {source}
),
{name} AS (
  SELECT scenario_id,
         CASE WHEN a < {earliest}
              THEN CASE WHEN {earliest} < {lo} THEN {lo} ELSE {earliest} END
              ELSE a END AS dateDebut,
         f AS dateFin
  FROM {name}_tenu
)"""


_DEFAULTED = f"""
completees AS (
  SELECT scenario_id, coalesce(dateDebut, DATE '1998-06-15') AS dateDebut,
         coalesce(dateFin, DATE '2000-06-15') AS dateFin
  FROM plages
), {_normalised('completees', '1996-01-01', '2001-06-30', 'parDefaut')}"""


def _edit_step(k: int) -> str:
    """The periods after the k-th edit of each scenario, from those before it."""
    return f"""
etape{k} AS (
  SELECT scenario_id,
         CASE WHEN v IS NULL THEN a WHEN sur_debut THEN w
              ELSE greatest(a, {_shift('w', -2)}) END AS a,
         CASE WHEN v IS NULL THEN f WHEN NOT sur_debut THEN w
              ELSE least(f, {_shift('w', 2)}, DATE '2001-06-30') END AS f,
         ajuste OR coalesce(v <> w, false) AS ajuste
  FROM (
    SELECT p.scenario_id, a, f, ajuste, sur_debut, v,
           CASE WHEN sur_debut THEN least(greatest(v, DATE '1996-01-01'), f)
                ELSE greatest(least(v, DATE '2001-06-30'), a) END AS w
    FROM etape{k - 1} p
    LEFT JOIN retouches r ON r.scenario_id = p.scenario_id AND r.seq = {k})
)"""


def _neutralised(priority: str, site: str, name: str) -> str:
    join = "JOIN customer ON c_custkey = o_custkey" if site == "c_nationkey" else ""
    return f"""
{name} AS (
  SELECT CAST({site} AS VARCHAR) AS site_id, o_orderkey AS id, o_orderkey AS ordre,
         CAST(o_orderdate AS DATE) AS dateDebut,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 1 AS INTEGER) AS dateFin,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'Motif ' || (o_orderkey % 5) END AS motif
  FROM orders {join} WHERE o_orderpriority = '{priority}'
)"""


SITES = """
sites AS (
  SELECT CAST(c_custkey AS VARCHAR) AS site_id, 'ROC' || c_custkey AS codeRoc,
         CAST(c_nationkey AS VARCHAR) AS codeRegate, c_name AS libelle,
         c_mktsegment AS libelleCourt, c_name || ' ' || c_mktsegment AS denomination
  FROM customer
)"""
PRODUCTS = """
produits AS (
  SELECT CAST(o_custkey AS VARCHAR) AS site_id, o_orderkey AS ordre,
         CAST(o_orderkey AS INTEGER) AS id, 'P' || (o_orderkey % 12) AS code,
         'Produit ' || (o_orderkey % 12) AS libelle, o_orderstatus = 'F' AS exclu
  FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
)"""
_PERIOD_TEXT = "concat_ws(':', id, dateDebut, dateFin, motif)"


_PERIOD_LISTS = [
    _neutralised("1-URGENT", "o_custkey", "generales"),
    _neutralised("2-HIGH", "o_custkey", "pointes"),
    _neutralised("3-MEDIUM", "o_custkey", "secondaires"),
]
_VARIATIONS = """
variations AS (
  SELECT CAST(o_custkey AS VARCHAR) AS site_id, o_orderkey AS ordre, 'C' || o_orderkey AS categorie,
         o_orderkey % 101 - 50 AS valeur
  FROM orders WHERE o_orderpriority = '5-LOW'
)"""


def _listed(name: str, source: str, text: str) -> str:
    return (
        f"{name}_t AS (SELECT site_id, string_agg({text}, ';' ORDER BY ordre) AS t "
        f"FROM {source} GROUP BY site_id)"
    )


_TYPE_NAMES = (
    "CASE {t} WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
    "WHEN 'FLOAT[]' THEN 'array<float>' ELSE {t} END"
)

# Columns of the given tables, in their order.
SCHEMAS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
    "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _column_rows() -> str:
    rows = []
    for table, names in SCHEMAS.items():
        for i, name in enumerate(names.split(), 1):
            kind = _TYPE_NAMES.format(t=f'max(typeof("{name}"))')
            rows.append(
                f"SELECT '{table}' AS table_name, {i} AS ordinal_position, "
                f"'{name}' AS column_name, {kind} AS column_type, "
                f"CAST(count(*) - count(\"{name}\") AS BIGINT) AS null_count FROM {table}"
            )
    return " UNION ALL ".join(rows)


PROFILE = (
    "profil AS (SELECT *, CASE WHEN null_count > 0 THEN 'YES' ELSE 'NO' END AS is_nullable "
    f"FROM ({_column_rows()}))"
)

_POSITION = ["da_comptage", "co_semaine_comptage", "co_mois_comptage", *DIMS.split(", ")]
# Spark sorts NULL first.
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in _POSITION)

ORACLE_SQL: dict[str, str] = {
    "traffic_scan": _with(
        MARTS, select="SELECT * FROM jours"
    ),
    "json_reference_scan": _with(
        SITES, select="SELECT codeRoc, codeRegate, libelle, libelleCourt, denomination FROM sites"
    ),
    "keyed_file_scan": _with(SCENARIOS, select=f"SELECT {SCENARIO_COLUMNS} FROM scenarios"),
    "keyed_file_scan_absent": _with(
        SCENARIOS,
        select="SELECT site_id, count(*) AS scenarios FROM scenarios "
        "WHERE site_id IN ('absent', '7') GROUP BY site_id",
    ),
    "nested_flatten": _with(
        COUNTS,
        TYPES,
        select="SELECT scenario_id, id, valeur, type_id AS trafic_id, code AS trafic_code, "
        "libelle AS trafic_libelle FROM comptages JOIN types USING (type_id)",
    ),
    "site_filter": _with(MARTS, select=_days("WHERE co_regate = '7'")),
    "multi_range_filter": _with(
        MARTS,
        select=_days(
            "WHERE co_regate = '12' AND (da_comptage BETWEEN '1996-02-26' AND '1996-03-03' "
            "OR da_comptage BETWEEN '1997-12-29' AND '1998-01-11' "
            "OR da_comptage BETWEEN '1999-06-01' AND '1999-06-01' "
            "OR da_comptage BETWEEN '2000-01-01' AND '2000-12-31')"
        ),
    ),
    "multi_range_filter_batched": _with(
        MARTS,
        """
plages AS (
  SELECT s_suppkey % 97 AS request_id, CAST(s_nationkey AS VARCHAR) AS co_regate,
         strftime(DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER), '%Y-%m-%d') AS a,
         strftime(DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 + s_suppkey * 53 % 200 AS INTEGER),
                  '%Y-%m-%d') AS b,
         s_suppkey % 13 = 0 AS sans_debut, s_suppkey % 17 = 0 AS sans_fin, s_suppkey % 19 = 0 AS inverse
  FROM supplier
),
bornes AS (
  SELECT request_id, co_regate,
         CASE WHEN sans_debut THEN NULL WHEN inverse THEN b ELSE a END AS cle_debut,
         CASE WHEN sans_fin THEN NULL WHEN inverse THEN a ELSE b END AS cle_fin
  FROM plages
)""",
        select=f"SELECT DISTINCT CAST(r.request_id AS BIGINT) AS request_id, {DIMS_J}, j.da_comptage, "
        "j.trafic_reel FROM jours j JOIN bornes r ON j.co_regate = r.co_regate "
        "AND (r.cle_debut IS NULL OR j.da_comptage >= r.cle_debut) "
        "AND (r.cle_fin IS NULL OR j.da_comptage <= r.cle_fin)",
    ),
    "project_all": _with(MARTS, select="SELECT * FROM semaines"),
    "level_filter": _with(
        MARTS, select="SELECT * FROM jours WHERE co_niveau_regroupement_operationnel = 'SITE'"
    ),
    "product_in_filter": _with(MARTS, select=f"SELECT * FROM jours WHERE co_comptage IN {KNOWN}"),
    "harmonise_grain": _with(
        MARTS,
        UNITED,
        select=f"SELECT periode, {DIMS}, cle AS cle_comptage, "
        "coalesce(trafic_reel, nb_objet_retenu) AS nb_objet_trafic_reel FROM uni",
    ),
    "table_preview": _with(
        MARTS,
        select=f"SELECT * FROM semaines WHERE co_regate = '3' "
        f"ORDER BY co_semaine_comptage, {DIMS} LIMIT 10",
    ),
    "scenarios_of_site": _with(
        SCENARIOS, select=f"SELECT {SCENARIO_COLUMNS} FROM scenarios WHERE site_id = '42'"
    ),
    "counts_of_scenario": _with(COUNTS, select="SELECT * FROM comptages WHERE scenario_id = 17"),
    "decompose_weeks_days": _with(
        REQUESTS,
        """
marques AS (
  SELECT request_id, co_regate, d,
         CASE WHEN date_trunc('week', d) >= dt_debut AND date_trunc('week', d) + INTERVAL 6 DAY <= dt_fin
              THEN 'semaines' ELSE 'jours' END AS periode
  FROM journees
),
groupes AS (
  SELECT *, d - CAST(row_number() OVER (PARTITION BY request_id, periode ORDER BY d) AS INTEGER)
              AS ilot
  FROM marques
)""",
        select="SELECT request_id, co_regate, periode, min(d) AS seg_debut, max(d) AS seg_fin "
        "FROM groupes GROUP BY request_id, co_regate, periode, ilot",
    ),
    "decompose_auto": _with(REQUESTS, LABELS, select="SELECT * FROM segments"),
    "segments_by_grain": _with(
        REQUESTS,
        LABELS,
        select="SELECT request_id, co_regate, periode, "
        f"string_agg({_key('seg_debut')} || ':' || {_key('seg_fin')}, ';' ORDER BY seg_debut) "
        "AS plages FROM segments GROUP BY request_id, co_regate, periode",
    ),
    "period_keys": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS cle_jour, "
    "strftime(o_orderdate, '%G-%V') AS cle_semaine, strftime(o_orderdate, '%Y-%m') AS cle_mois "
    "FROM orders",
    "concat_grains": _with(MARTS, UNITED, select=f"SELECT {OUT} FROM uni"),
    "route_traffic": _with(
        MARTS, UNITED, REQUESTS, LABELS, KEYS, ROUTED, select=f"SELECT request_id, {OUT} FROM route"
    ),
    "route_fixed_grain": _with(
        MARTS,
        UNITED,
        RAW,
        JUDGED_MODE,
        _TYPED_DAYS,
        LABELS.replace("request_id, co_regate, d,", "request_id, co_regate, mode, d,"),
        f"""
modes AS (
  SELECT request_id, co_regate, d, CASE WHEN mode = 'auto' THEN periode ELSE mode END AS periode
  FROM etiquettes
),
cles AS (SELECT DISTINCT request_id, co_regate, periode, {_key('d')} AS cle FROM modes)""",
        ROUTED,
        select=f"SELECT request_id, {OUT} FROM route",
    ),
    "routing_preview": _with(
        REQUESTS,
        LABELS,
        select="SELECT request_id, co_regate, periode, 'gold.default.g_mdp_trafics_' || "
        "CASE periode WHEN 'mois' THEN 'mois' WHEN 'semaines' THEN 'semaine' ELSE 'jour' END "
        f"|| '_actualise' AS table_lue, {_key('seg_debut')} AS cle_debut, "
        f"{_key('seg_fin')} AS cle_fin FROM segments",
    ),
    "parse_dates": _with(RAW, JUDGED, select="SELECT request_id, dt_debut, dt_fin FROM jugees"),
    "validate_requests": _with(
        RAW,
        JUDGED,
        select="SELECT request_id, dt_debut, dt_fin, manquants, ecart_jours, motif FROM jugees",
    ),
    "validate_mode_requests": _with(
        RAW, JUDGED_MODE, select="SELECT request_id, mode, motif FROM jugees"
    ),
    "validate_calendar_requests": _with(
        RAW,
        JUDGED_CALENDAR,
        select="SELECT request_id, dt_debut, dt_fin, manquants, ecart_jours, motif FROM jugees",
    ),
    "validate_counts": _with(
        EDITS,
        select="SELECT seq, type_id, valeur, CASE WHEN type_id IS NULL THEN 'type' "
        "WHEN valeur IS NULL THEN 'valeur' WHEN valeur < 0 THEN 'negatif' END AS motif_rejet "
        "FROM journal WHERE op = 'ajout'",
    ),
    "validate_names": _with(
        NEW_SCENARIOS,
        select="SELECT *, CASE WHEN trim(nom) = '' THEN 'nom' END AS motif_rejet FROM noms",
    ),
    "validate_periods": _with(
        SCENARIOS,
        select="SELECT scenario_id, coalesce(CAST(dateDebut AS VARCHAR), '') AS dateDebut, "
        "coalesce(CAST(dateFin AS VARCHAR), '') AS dateFin, "
        "CASE WHEN dateDebut IS NULL OR dateFin IS NULL THEN 'dates' END AS motif_rejet "
        "FROM plages",
    ),
    "traffic_group_sum": _with(
        MARTS,
        UNITED,
        REQUESTS,
        LABELS,
        KEYS,
        ROUTED,
        select=f"SELECT request_id, periode, cle AS cle_comptage, {DIMS}, "
        "CAST(sum(coalesce(trafic_reel, nb_objet_retenu)) AS BIGINT) AS nb_objet_trafic_reel "
        f"FROM route WHERE co_niveau_regroupement_operationnel = 'SITE' AND co_comptage IN {KNOWN} "
        f"GROUP BY request_id, periode, cle, {DIMS}",
    ),
    "traffic_count_only": _with(
        MARTS,
        UNITED,
        REQUESTS,
        LABELS,
        KEYS,
        ROUTED,
        select="SELECT d.request_id, d.co_regate, d.dt_debut, d.dt_fin, count(r.periode) AS total "
        "FROM demandes d LEFT JOIN route r ON r.request_id = d.request_id "
        f"AND r.co_niveau_regroupement_operationnel = 'SITE' AND r.co_comptage IN {KNOWN} "
        "GROUP BY ALL",
    ),
    "result_count": _with(
        MARTS,
        UNITED,
        REQUESTS,
        LABELS,
        KEYS,
        ROUTED,
        select='SELECT d.request_id, d.co_regate, d.dt_debut, d.dt_fin, count(r.periode) AS "count" '
        "FROM demandes d LEFT JOIN route r ON r.request_id = d.request_id GROUP BY ALL",
    ),
    "open_days_by_week": _with(
        REQUESTS,
        select="SELECT request_id, strftime(d, '%G-S%V') AS semaine, "
        "strftime(min(d), '%Y%m%d') AS date_debut_semaine, "
        "strftime(max(d), '%Y%m%d') AS date_fin_semaine, "
        "CAST(count(*) FILTER (isodow(d) <> 7) AS INTEGER) AS nbr_jours_ouverts "
        "FROM journees GROUP BY ALL",
    ),
    "open_days_total": _with(
        REQUESTS,
        select="SELECT request_id, "
        "CAST(count(*) FILTER (isodow(d) <> 7) AS INTEGER) AS total_jours_ouverts, "
        "CAST(count(DISTINCT strftime(d, '%G-%V')) AS INTEGER) AS nbr_semaines "
        "FROM journees GROUP BY request_id",
    ),
    "traffic_headers": _with(
        MARTS,
        UNITED,
        RAW,
        JUDGED,
        _TYPED_DAYS,
        LABELS,
        KEYS,
        ROUTED,
        """
parGrain AS (
  SELECT request_id, periode, count(*) AS n FROM route GROUP BY 1, 2
)""",
        select="SELECT j.request_id, j.co_regate, CAST(dt_debut AS VARCHAR) AS date_debut, "
        "CAST(dt_fin AS VARCHAR) AS date_fin, CAST(coalesce(sum(n), 0) AS BIGINT) AS \"count\" "
        "FROM jugees j LEFT JOIN parGrain g ON g.request_id = j.request_id "
        "WHERE motif IS NULL GROUP BY ALL",
    ),
    "traffic_headers_limited": _with(
        MARTS,
        UNITED,
        RAW,
        JUDGED,
        _TYPED_DAYS,
        LABELS,
        KEYS,
        ROUTED,
        """
parGrain AS (
  SELECT request_id, periode, least(count(*), 5) AS n FROM route GROUP BY 1, 2
)""",
        select="SELECT j.request_id, j.co_regate, CAST(dt_debut AS VARCHAR) AS date_debut, "
        "CAST(dt_fin AS VARCHAR) AS date_fin, CAST(coalesce(sum(n), 0) AS BIGINT) AS \"count\" "
        "FROM jugees j LEFT JOIN parGrain g ON g.request_id = j.request_id "
        "WHERE motif IS NULL GROUP BY ALL",
    ),
    "calendar_headers": _with(
        RAW,
        JUDGED_CALENDAR,
        _TYPED_DAYS,
        select="SELECT s.request_id, s.date_debut, s.date_fin, "
        "CAST(count(*) FILTER (isodow(d) <> 7) AS INTEGER) AS total_jours_ouverts, "
        "CAST(count(DISTINCT strftime(d, '%G-%V')) AS INTEGER) AS nbr_semaines "
        "FROM journees j JOIN saisies s ON s.request_id = j.request_id GROUP BY ALL",
    ),
    "dataset_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS table_rows FROM {t}" for t in TABLES
    ),
    "dataset_row_counts_footers": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS table_rows FROM {t}" for t in TABLES
    ),
    "column_profile": _with(
        PROFILE,
        select="SELECT table_name, ordinal_position, column_name, column_type, null_count, "
        "is_nullable FROM profil",
    ),
    "order_by_name": _with(
        PROFILE,
        select="SELECT table_name, column_name, ordinal_position FROM profil "
        "ORDER BY table_name, column_name",
    ),
    "nested_schema_report": _with(
        PROFILE,
        select="SELECT table_name, CAST(count(*) AS INTEGER) AS column_count, string_agg("
        "concat_ws(':', ordinal_position, column_name, column_type, is_nullable, null_count), ';' "
        "ORDER BY ordinal_position) AS columns FROM profil GROUP BY table_name",
    ),
    "limit_per_grain": _with(
        MARTS,
        UNITED,
        REQUESTS,
        LABELS,
        KEYS,
        ROUTED,
        select=f"SELECT request_id, {OUT} FROM route QUALIFY row_number() OVER "
        f"(PARTITION BY request_id, periode ORDER BY {_ORDER}) <= 5",
    ),
    "table_sample": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25",
    "paginate_result": _with(
        MARTS,
        UNITED,
        REQUESTS,
        LABELS,
        KEYS,
        ROUTED,
        select=f"SELECT request_id, {OUT}, CAST(row_number() OVER (PARTITION BY request_id "
        f"ORDER BY periode, {_ORDER}) AS INTEGER) AS rang FROM route QUALIFY rang BETWEEN 21 AND 40",
    ),
    "available_types": _with(
        COUNTS,
        TYPES,
        select="SELECT o_orderkey AS scenario_id, t.type_id, t.code, t.libelle "
        "FROM orders CROSS JOIN types t ANTI JOIN comptages c "
        "ON c.scenario_id = o_orderkey AND c.type_id = t.type_id",
    ),
    "lookup_type": _with(
        EDITS,
        TYPES,
        select="SELECT seq, scenario_id, type_id, code, libelle, valeur "
        "FROM journal JOIN types USING (type_id) WHERE op = 'ajout'",
    ),
    "default_fallback": _with(
        SITES,
        PRODUCTS,
        select="SELECT site_id, id, code, libelle, exclu FROM produits UNION ALL "
        "SELECT s.site_id, i, 'P0' || i, 'Produit 0' || i, false FROM sites s, "
        "(SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS i) "
        "WHERE s.site_id NOT IN (SELECT site_id FROM produits)",
    ),
    "new_scenario_defaults": _with(
        NEW_SCENARIOS,
        select="SELECT site_id, seq, trim(nom) AS nom, DATE '1998-06-15' AS dateCreation, "
        "'Brouillon' AS statut, NULL::DATE AS dateValidation, NULL::DATE AS dateMo, "
        "NULL::DATE AS dateProduction, NULL::DATE AS periode_dateDebut, "
        "NULL::DATE AS periode_dateFin FROM noms WHERE trim(nom) <> ''",
    ),
    "append_with_next_id": _with(
        SCENARIOS,
        NEW_SCENARIOS,
        """
gardes AS (
  SELECT s.* FROM scenarios s JOIN orders o ON o.o_orderkey = s.id
  WHERE o.o_orderpriority <> '1-URGENT'
)""",
        select=f"SELECT {SCENARIO_COLUMNS} FROM gardes UNION ALL "
        "SELECT CAST(coalesce((SELECT max(id) FROM gardes g WHERE g.site_id = n.site_id), 0) "
        "+ row_number() OVER (PARTITION BY n.site_id ORDER BY n.seq) AS BIGINT), n.site_id, "
        "trim(n.nom), DATE '1998-06-15', 'Brouillon', NULL, NULL, NULL, NULL, NULL "
        "FROM noms n WHERE trim(n.nom) <> ''",
    ),
    "append_interleaved": "WITH RECURSIVE " + ",".join([SCENARIOS, NEW_SCENARIOS, """
haut AS (SELECT site_id, max(id) AS m FROM scenarios GROUP BY site_id),
journal AS (
  SELECT site_id, seq, 'ajout' AS op, NULL::BIGINT AS id, trim(nom) AS nom FROM noms WHERE trim(nom) <> ''
  UNION ALL
  SELECT CAST(e.user_id % 100 AS VARCHAR), e.event_id, 'suppression', coalesce(h.m, 0) + e.event_id % 3, NULL
  FROM events e LEFT JOIN haut h ON h.site_id = CAST(e.user_id % 100 AS VARCHAR)
  WHERE e.event_type = 'error'
),
pas AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seq, op, id) AS k FROM journal),
depart AS (
  SELECT p.site_id, coalesce(list(s.id) FILTER (WHERE s.id IS NOT NULL), []::BIGINT[]) AS vivants
  FROM (SELECT DISTINCT site_id FROM pas) p LEFT JOIN scenarios s ON s.site_id = p.site_id
  GROUP BY p.site_id
),
etat(site_id, k, vivants, donne) AS (
  SELECT site_id, 0, vivants, NULL::BIGINT FROM depart
  UNION ALL
  SELECT e.site_id, e.k + 1,
    CASE WHEN p.op = 'ajout' THEN list_append(e.vivants, coalesce(list_max(e.vivants), 0) + 1)
         ELSE list_filter(e.vivants, lambda x: x <> p.id) END,
    CASE WHEN p.op = 'ajout' THEN coalesce(list_max(e.vivants), 0) + 1 END
  FROM etat e JOIN pas p ON p.site_id = e.site_id AND p.k = e.k + 1
),
donnes AS (
  SELECT e.site_id, e.donne AS id, max(p.seq) AS seq, arg_max(p.nom, p.seq) AS nom
  FROM etat e JOIN pas p ON p.site_id = e.site_id AND p.k = e.k
  WHERE p.op = 'ajout' GROUP BY e.site_id, e.donne
),
fin AS (
  SELECT site_id, unnest(vivants) AS id FROM etat
  WHERE (site_id, k) IN (SELECT (site_id, max(k)) FROM etat GROUP BY site_id)
  UNION ALL
  SELECT site_id, id FROM scenarios WHERE site_id NOT IN (SELECT site_id FROM pas)
)"""]) + """
SELECT f.site_id, CAST(f.id AS BIGINT) AS id, coalesce(d.nom, s.nom) AS nom, CAST(d.seq AS BIGINT) AS seq
FROM fin f LEFT JOIN donnes d ON d.site_id = f.site_id AND d.id = f.id
LEFT JOIN scenarios s ON s.site_id = f.site_id AND s.id = f.id
""",
    "delete_by_id": _with(
        COUNTS,
        EDITS,
        select="SELECT c.* FROM comptages c ANTI JOIN "
        "(SELECT * FROM journal WHERE op = 'suppression') j "
        "ON j.scenario_id = c.scenario_id AND j.id = c.id",
    ),
    "update_values": _with(
        COUNTS,
        EDITS,
        select="SELECT c.scenario_id, c.id, c.type_id, CASE WHEN u.seq IS NULL THEN c.valeur "
        "ELSE u.valeur END AS valeur FROM comptages c LEFT JOIN "
        "(SELECT * FROM journal WHERE op = 'modification' QUALIFY row_number() OVER "
        "(PARTITION BY scenario_id, id ORDER BY seq DESC) = 1) u "
        "ON u.scenario_id = c.scenario_id AND u.id = c.id",
    ),
    "apply_count_edits": _with(COUNTS, TYPES, EDITS, EDITED, select="SELECT * FROM apres"),
    "detect_changes": _with(
        COUNTS,
        TYPES,
        EDITS,
        EDITED,
        """
texte_avant AS (
  SELECT scenario_id, string_agg(type_id || '=' || coalesce(CAST(valeur AS VARCHAR), 'null'), ';'
           ORDER BY id) AS t
  FROM comptages GROUP BY 1
),
texte_apres AS (
  SELECT scenario_id, string_agg(type_id || '=' || coalesce(CAST(valeur AS VARCHAR), 'null'), ';'
           ORDER BY id) AS t
  FROM apres GROUP BY 1
)""",
        select="SELECT scenario_id, a.t IS DISTINCT FROM b.t AS modifie "
        "FROM texte_avant a FULL JOIN texte_apres b USING (scenario_id)",
    ),
    "detect_changes_by_position": _with(
        COUNTS,
        TYPES,
        EDITS,
        EDITED,
        """
tetes AS (SELECT scenario_id, max(id) AS top FROM comptages GROUP BY 1),
texte_avant AS (
  SELECT scenario_id, string_agg(type_id || '=' || coalesce(CAST(valeur AS VARCHAR), 'null'), ';'
           ORDER BY id DESC) AS t
  FROM comptages GROUP BY 1
),
texte_apres AS (
  SELECT l.scenario_id,
         string_agg(type_id || '=' || coalesce(CAST(valeur AS VARCHAR), 'null'), ';'
           ORDER BY CASE WHEN id <= coalesce(top, 0) THEN -id ELSE id END) AS t
  FROM apres l LEFT JOIN tetes h ON h.scenario_id = l.scenario_id GROUP BY 1
)""",
        select="SELECT scenario_id, a.t IS DISTINCT FROM b.t AS modifie "
        "FROM texte_avant a FULL JOIN texte_apres b USING (scenario_id)",
    ),
    "param_entries": _with(
        SITES,
        PRODUCTS,
        *_PERIOD_LISTS,
        _VARIATIONS,
        f"""
entrees AS (
  SELECT site_id, 'periodesNeutralisees' AS liste, ordre, {_PERIOD_TEXT} AS texte FROM generales
  UNION ALL SELECT site_id, 'neutralisationsPeak', ordre, {_PERIOD_TEXT} FROM pointes
  UNION ALL SELECT site_id, 'neutralisationsSecondaires', ordre, {_PERIOD_TEXT} FROM secondaires
  UNION ALL SELECT site_id, 'variationsTrafic', ordre, concat_ws(':', categorie, -50, 50, valeur)
    FROM variations
  UNION ALL SELECT site_id, 'produitsExclus', ordre, concat_ws(':', id, code, libelle, exclu)
    FROM produits
),
placees AS (
  SELECT CASE WHEN ordre % 50 = 0 THEN 'inconnu' WHEN ordre % 50 <> 1 THEN site_id END AS site_id,
         liste, ordre, texte
  FROM entrees
)""",
        select="SELECT p.site_id, liste, row_number() OVER "
        "(PARTITION BY p.site_id, liste ORDER BY ordre) AS rang, libelle, texte "
        "FROM placees p LEFT JOIN sites s ON s.site_id = p.site_id",
    ),
    "param_payload": _with(
        SITES,
        PRODUCTS,
        *_PERIOD_LISTS,
        _VARIATIONS,
        _listed("generales", "generales", _PERIOD_TEXT),
        _listed("pointes", "pointes", _PERIOD_TEXT),
        _listed("secondaires", "secondaires", _PERIOD_TEXT),
        _listed("variations", "variations", "concat_ws(':', categorie, -50, 50, valeur)"),
        _listed("produits", "produits", "concat_ws(':', id, code, libelle, exclu)"),
        select="SELECT s.site_id, CAST(0 AS BIGINT) AS partie, codeRoc, codeRegate, libelle, "
        "libelleCourt, denomination, coalesce(g.t, '') AS periodesNeutralisees, "
        "coalesce(v.t, '') AS variationsTrafic, coalesce(p.t, '') AS neutralisationsPeak, "
        "coalesce(n.t, '') AS neutralisationsSecondaires, coalesce(x.t, '') AS produitsExclus "
        "FROM sites s LEFT JOIN generales_t g ON g.site_id = s.site_id "
        "LEFT JOIN variations_t v ON v.site_id = s.site_id "
        "LEFT JOIN pointes_t p ON p.site_id = s.site_id "
        "LEFT JOIN secondaires_t n ON n.site_id = s.site_id "
        "LEFT JOIN produits_t x ON x.site_id = s.site_id",
    ),
    "normalise_periods": _with(
        SCENARIOS,
        _normalised("plages", "1996-01-01", "2001-06-30", "normees"),
        select="SELECT * FROM normees",
    ),
    "default_periods": _with(SCENARIOS, _DEFAULTED, select="SELECT * FROM parDefaut"),
    "apply_period_edits": _with(
        SCENARIOS,
        _DEFAULTED,
        f"""
retouches AS (
  SELECT o_orderkey AS scenario_id, o_orderkey % 2 = 0 AS sur_debut,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey * 131 % 9000 - 3000 AS INTEGER) AS v
  FROM orders WHERE o_orderkey % 7 <> 0
),
bornees AS (
  SELECT p.scenario_id, dateDebut AS a, dateFin AS f, sur_debut, v,
         CASE WHEN sur_debut THEN least(greatest(v, DATE '1996-01-01'), dateFin)
              ELSE greatest(least(v, DATE '2001-06-30'), dateDebut) END AS w
  FROM parDefaut p LEFT JOIN retouches r ON r.scenario_id = p.scenario_id
)""",
        select=f"""SELECT scenario_id,
       CASE WHEN v IS NULL THEN a WHEN sur_debut THEN w
            ELSE greatest(a, {_shift('w', -2)}) END AS dateDebut,
       CASE WHEN v IS NULL THEN f WHEN NOT sur_debut THEN w
            ELSE least(f, least({_shift('w', 2)}, DATE '2001-06-30')) END AS dateFin,
       coalesce(v <> w, false) AS ajuste
FROM bornees""",
    ),
    "apply_period_edit_log": _with(
        SCENARIOS,
        _DEFAULTED,
        """
retouches AS (
  SELECT o_orderkey AS scenario_id, seq, (o_orderkey // 2 + seq) % 2 = 0 AS sur_debut,
         CAST(o_orderdate AS DATE)
           + CAST((o_orderkey * 131 + seq * 977) % 9000 - 3000 AS INTEGER) AS v
  FROM orders, range(1, 5) t(seq)
  WHERE seq <= o_orderkey % 4 + 1 AND (o_orderkey + seq) % 7 <> 0
),
etape0 AS (
  SELECT scenario_id, dateDebut AS a, dateFin AS f, false AS ajuste FROM parDefaut
)""",
        *[_edit_step(k) for k in range(1, 5)],
        select="SELECT scenario_id, a AS dateDebut, f AS dateFin, ajuste FROM etape4",
    ),
    "period_duration": _with(
        SCENARIOS,
        _DEFAULTED,
        """
ecarts AS (
  SELECT scenario_id, dateDebut, dateFin, year(dateFin) - year(dateDebut) AS y,
         month(dateFin) - month(dateDebut) AS m, day(dateFin) - day(dateDebut) AS j,
         day(date_trunc('month', dateFin) - INTERVAL 1 DAY) AS veille
  FROM parDefaut
),
mois_justes AS (
  SELECT *, CASE WHEN j < 0 THEN m - 1 ELSE m END AS m1, CASE WHEN j < 0 THEN j + veille ELSE j END AS j1
  FROM ecarts
),
justes AS (
  SELECT scenario_id, dateDebut, dateFin,
         CAST(CASE WHEN m1 < 0 THEN y - 1 ELSE y END AS INTEGER) AS ans,
         CAST(CASE WHEN m1 < 0 THEN m1 + 12 ELSE m1 END AS INTEGER) AS mois,
         CAST(j1 AS INTEGER) AS jours
  FROM mois_justes
)""",
        select="SELECT scenario_id, dateDebut, dateFin, "
        "CAST(date_diff('day', dateDebut, dateFin) AS INTEGER) AS jours_total, ans, mois, jours, "
        "CASE WHEN ans <= 0 AND mois <= 0 AND jours <= 0 THEN '0 jour' ELSE concat_ws(' ', "
        "CASE WHEN ans = 1 THEN '1 an' WHEN ans > 1 THEN ans || ' ans' END, "
        "CASE WHEN mois > 0 THEN mois || ' mois' END, "
        "CASE WHEN jours = 1 THEN '1 jour' WHEN jours > 1 THEN jours || ' jours' END) END "
        "AS duree FROM justes",
    ),
    "period_position": _with(
        SCENARIOS,
        _DEFAULTED,
        select="SELECT scenario_id, dateDebut, dateFin, "
        "CASE WHEN DATE '1998-06-15' < dateDebut THEN 'avant' "
        "WHEN DATE '1998-06-15' > dateFin THEN 'apres' ELSE 'pendant' END AS position "
        "FROM parDefaut",
    ),
    "weekly_mean": "SELECT p_brand AS produit, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) "
    "AS volumeBrut, CAST(sum(CAST(l_quantity AS BIGINT)) // 7 AS BIGINT) AS traficMoyenHebdo "
    "FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand",
    "drop_neutralised_days": _with(
        MARTS,
        _neutralised("1-URGENT", "c_nationkey", "generales"),
        _neutralised("2-HIGH", "c_nationkey", "pointes"),
        _neutralised("3-MEDIUM", "c_nationkey", "secondaires"),
        """
fermes AS (
  SELECT site_id, dateDebut, dateFin FROM generales
  UNION ALL SELECT site_id, dateDebut, dateFin FROM pointes
  UNION ALL SELECT site_id, dateDebut, dateFin FROM secondaires
)""",
        select="SELECT j.* FROM jours j WHERE NOT EXISTS (SELECT 1 FROM fermes f "
        "WHERE f.site_id = j.co_regate "
        "AND CAST(j.da_comptage AS DATE) BETWEEN f.dateDebut AND f.dateFin)",
    ),
    "drop_excluded_products": _with(
        MARTS,
        f"""
exclus AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS site_id, ({CODES})[c_custkey % 12 + 1] AS code
  FROM customer GROUP BY ALL HAVING sum(c_custkey) % 2 = 0
)""",
        select="SELECT m.* FROM jours m ANTI JOIN exclus e "
        "ON e.site_id = m.co_regate AND e.code = m.co_comptage",
    ),
    "apply_variation": _with(
        MARTS,
        """
taux AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS site_id, 'T' || (c_custkey % 3) AS categorie,
         least(50, greatest(-50, CAST(sum(c_custkey) % 121 - 60 AS INTEGER))) AS v
  FROM customer GROUP BY ALL
)""",
        select="SELECT m.*, CAST(trafic_reel * (coalesce(v, 0) + 100) AS DOUBLE) / 100.0 "
        "AS trafic_varie FROM jours m LEFT JOIN taux "
        "ON site_id = co_regate AND categorie = co_type_objet",
    ),
    "site_bridge": _with(
        MARTS,
        select="SELECT m.*, 'ROC' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS codeRoc, "
        "n_name AS libelle FROM jours m JOIN nation ON CAST(n_nationkey AS VARCHAR) = co_regate",
    ),
}
