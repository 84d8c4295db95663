"""The SQL side of the checks: named DuckDB views, from raw data to Gold, put together on demand.

`sql(text)` prefixes a SELECT with the views it names, directly or through other views.
"""

from __future__ import annotations

import re

from checks import fixtures
from sparkprep import schema

RUN = "run_a"
VIEWS: dict[str, str] = {"fx_city": fixtures.FX_CITY_SQL}
MASTER_KEY = {m: schema.DEDUP_KEYS[m][0] for m in schema.MASTERS}


def sql(text: str) -> str:
    needed: list[str] = []

    def visit(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z][a-z_]*\b", body)):
            if word in VIEWS and word not in needed:
                visit(VIEWS[word])
                needed.append(word)

    visit(text)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" if needed else "") + text


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def columns(dataset: str) -> list[str]:
    mapping = fixtures.MAPPINGS[dataset]
    return [mapping.get(c, f"raw__{c}") for c in fixtures.raw_columns(dataset)]


def clean(c: str) -> str:
    tokens = ", ".join(quote(t) for t in schema.NULL_TOKENS)
    return f"CASE WHEN trim({c}) IN ({tokens}) THEN NULL ELSE trim({c}) END"


def category(c: str, field: str) -> str:
    pairs = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in schema.CATEGORICALS[field].items())
    return f"CASE lower(trim({c})) {pairs} ELSE {c} END"


def _typed(dataset: str) -> str:
    kinds, out = schema.field_types(dataset), ["_row_ord"]
    for rawname, name in zip(fixtures.raw_columns(dataset), columns(dataset)):
        kind, e = kinds.get(name), rawname
        if kind == "float":
            e = f"TRY_CAST({e} AS DOUBLE)"
        elif kind == "date":
            e = f"TRY_CAST({e} AS TIMESTAMP)"
        elif name not in schema.TYPED_BY_NAME:
            e = clean(e)
            if name in schema.CATEGORICALS:
                e = category(f"({e})", name)
        out.append(f"{e} AS {name}")
    return f"SELECT {', '.join(out)} FROM raw_{dataset}"


def _rule(rule: dict, present: list[str]) -> str:
    f, kind = rule["field"], rule["type"]
    if f not in present:
        return "TRUE"
    if kind == "date_range":
        return f"coalesce({f} BETWEEN TIMESTAMP '{rule['start']}' AND TIMESTAMP '{rule['end']}', FALSE)"
    if kind == "numeric_range":
        parts = [f"{f} >= {rule['min']}"] + ([f"{f} <= {rule['max']}"] if "max" in rule else [])
        return f"coalesce({' AND '.join(parts)}, FALSE)"
    listed = ", ".join(quote(v.strip().lower()) for v in rule["values"])
    hit = f"coalesce(lower(trim(CAST({f} AS VARCHAR))) IN ({listed}), FALSE)"
    return hit if kind == "include_values" else f"NOT {hit}"


def _direct(dataset: str) -> str:
    rules = fixtures.SCOPE_RULES.get(dataset, [])
    tests = [_rule(r, columns(dataset)) for r in rules]
    names = [r.get("description") or f"{r['type']} rule on '{r['field']}'" for r in rules]
    reason = " ".join(f"WHEN NOT ({t}) THEN {quote(n)}" for t, n in zip(tests, names))
    return (
        f"SELECT *, {' AND '.join(f'({t})' for t in tests) or 'TRUE'} AS scope_included, "
        + (f"CASE {reason} END" if reason else "CAST(NULL AS VARCHAR)")
        + f" AS scope_exclusion_reason FROM silver_{dataset}"
    )


def _scoped(dataset: str) -> str:
    keys = [(f, m) for f, m in schema.cascade_keys(dataset) if fixtures.SCOPE_RULES.get(m)]
    if dataset in schema.MASTERS or not keys:
        return f"SELECT * FROM direct_{dataset}"
    joins, whens = [], []
    for i, (f, m) in enumerate(keys):
        joins.append(
            f"LEFT JOIN (SELECT DISTINCT {MASTER_KEY[m]} AS k{i} FROM direct_{m} "
            f"WHERE NOT scope_included AND {MASTER_KEY[m]} IS NOT NULL) e{i} ON d.{f} = e{i}.k{i}"
        )
        whens.append(f"WHEN k{i} IS NOT NULL THEN 'Excluded via cascade: {f} ''' || d.{f} || ''' is excluded in {m}'")
    hit = " OR ".join(f"k{i} IS NOT NULL" for i in range(len(keys)))
    return (
        f"SELECT d.* EXCLUDE (scope_included, scope_exclusion_reason), scope_included AND NOT ({hit}) AS scope_included, "
        f"CASE WHEN NOT scope_included THEN scope_exclusion_reason {' '.join(whens)} END AS scope_exclusion_reason "
        f"FROM direct_{dataset} d {' '.join(joins)}"
    )


def checks_of(dataset: str) -> list[tuple]:
    """(field, failing condition, issue type, description, severity, raw value, review, invalidates)"""
    present, out = columns(dataset), []
    for f in schema.required_fields(dataset):
        if f in present:
            out.append((f, f"({f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '')", "missing_mandatory_field",
                        quote(f"Required field '{f}' is missing."), "high", "NULL", f in schema.GEO_FIELDS, True))
    for f in schema.NON_NEGATIVE_FIELDS:
        if f in present:
            out.append((f, f"coalesce({f} < 0, FALSE)", "invalid_numeric_value",
                        f"'Field ''{f}'' has a negative value (' || CAST({f} AS VARCHAR) || ').'", "high",
                        f"CAST({f} AS VARCHAR)", False, True))
    if "quantity_on_hand" in present:
        f = "quantity_on_hand"
        out.append((f, f"coalesce({f} < 0, FALSE)", "negative_inventory_exception",
                    f"'Negative on-hand quantity (' || CAST({f} AS VARCHAR) || ').'", "medium", f"CAST({f} AS VARCHAR)", True, False))
    for f, bound in (("latitude", 90), ("longitude", 180)):
        if f in present:
            out.append((f, f"coalesce({f} NOT BETWEEN -{bound} AND {bound}, FALSE)", "invalid_range",
                        quote(f"{f.capitalize()} out of range."), "high", f"CAST({f} AS VARCHAR)", False, True))
    if dataset == "shipment_history":
        out.append(("direction", "coalesce(lower(trim(direction)) NOT IN ('inbound', 'outbound'), FALSE)", "invalid_direction_value",
                    "'Direction value ''' || direction || ''' is not valid. Must be ''Inbound'' or ''Outbound''.'", "high",
                    "direction", False, True))
    return out


def _checked(dataset: str) -> str:
    todo = checks_of(dataset)
    bad = " OR ".join(c[1] for c in todo if c[7])
    review = " OR ".join(c[1] for c in todo if c[6]) or "FALSE"
    return (
        f"SELECT *, CASE WHEN needs_review THEN 'needs_review' WHEN is_valid THEN 'valid' ELSE 'invalid' END AS row_status "
        f"FROM (SELECT *, NOT ({bad}) AS is_valid, ({review}) AS needs_review FROM scoped_{dataset})"
    )


def record_id(dataset: str) -> str:
    return schema.RECORD_ID.get(dataset, "shipment_id")


def _issues(dataset: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset_name, '{RUN}' AS run_id, {record_id(dataset)} AS record_id, _row_ord, "
        f"'{f}' AS canonical_field, '{kind}' AS issue_type, {text} AS issue_description, '{sev}' AS severity, "
        f"CAST({rawv} AS VARCHAR) AS raw_value, {str(review).upper()} AS manual_review_required "
        f"FROM checked_{dataset} WHERE {cond}"
        for f, cond, kind, text, sev, rawv, review, _ in checks_of(dataset)
    )


def strip_prefix(c: str) -> str:
    bare = f"regexp_replace(trim({c}), '^[A-Za-z_\\-\\s]+', '')"
    return f"CASE WHEN {bare} = '' THEN trim({c}) ELSE {bare} END"


def _keys_sql(dataset: str, parents: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT {schema.DEDUP_KEYS[p][0]} AS key, '{p}' AS parent FROM silver_{p} WHERE {schema.DEDUP_KEYS[p][0]} IS NOT NULL" for p in parents
    )


def _xref(dataset: str) -> None:
    """Views xref_<dataset> (one column set per rule), gold_<dataset>, exceptions_<dataset>."""
    source, valid, items, dest = f"checked_{dataset}", [], [], None
    joins, select = [], []
    for i, fk in enumerate(schema.FOREIGN_KEYS[dataset]):
        keys = f"keys_{dataset}_{'abc'[i]}"
        VIEWS[keys] = _keys_sql(dataset, (*fk.parents, *fk.also))
        first = fk.parents[0]
        joins.append(
            f"LEFT JOIN (SELECT key AS ek{i}, bool_or(parent = '{first}') AS ep{i} FROM {keys} GROUP BY key) x{i} ON trim(g.{fk.field}) = x{i}.ek{i} "
            f"LEFT JOIN (SELECT bare AS sk{i}, bool_or(parent = '{first}') AS sp{i}, min(CASE WHEN key <> bare THEN key END) AS sm{i} "
            f"FROM (SELECT *, {strip_prefix('key')} AS bare FROM {keys}) GROUP BY bare) y{i} ON ({strip_prefix(f'g.{fk.field}')}) = y{i}.sk{i}"
        )
        select.append(f"ek{i}, ep{i}, sk{i}, sp{i}, sm{i}")
        found = f"(ek{i} IS NOT NULL OR sk{i} IS NOT NULL)"
        valid.append((fk.field, f"({fk.field} IS NULL OR {found})"))
        kind, expected = "CAST(NULL AS VARCHAR)", f"'{fk.expected}'"
        if len(fk.parents) > 1:
            loc = f"(coalesce(ep{i}, FALSE) OR coalesce(sp{i}, FALSE))"
            kind = f"CASE WHEN {fk.field} IS NULL THEN NULL WHEN {loc} THEN 'internal' WHEN {found} THEN 'external' ELSE 'unknown' END"
            expected = f"CASE WHEN {loc} THEN '{first}' WHEN {found} THEN '{fk.parents[1]}' ELSE '{fk.expected}' END"
            dest = kind
        items.append(
            f"SELECT '{dataset}' AS dataset_name, '{RUN}' AS run_id, {record_id(dataset)} AS record_id, _row_ord, '{fk.field}' AS field, "
            f"trim({fk.field}) AS invalid_value, CASE WHEN {found} THEN coalesce(sm{i}, {strip_prefix(fk.field)}) END AS matched_value, "
            f"{expected} AS expected_master, CASE WHEN {found} THEN 'prefix_stripped' ELSE 'no_match' END AS match_type, "
            f"{kind} AS destination_type, 1 AS count FROM xref_{dataset} WHERE {fk.field} IS NOT NULL AND ek{i} IS NULL"
        )
    VIEWS[f"xref_{dataset}"] = f"SELECT g.*, {', '.join(select)} FROM {source} g {' '.join(joins)}"
    ok = " AND ".join(v for _, v in valid)
    flags = ", ".join(f"{v} AS {f}_valid_ref" for f, v in valid) + (f", {dest} AS destination_type" if dest else "")
    drop = ", ".join(s for s in select)
    VIEWS[f"gold_{dataset}"] = (
        f"SELECT * EXCLUDE ({drop}, is_valid, row_status), {flags}, is_valid AND {ok} AS is_valid, "
        f"CASE WHEN ({ok}) OR row_status = 'needs_review' THEN row_status ELSE 'invalid' END AS row_status FROM xref_{dataset}"
    )
    VIEWS[f"exceptions_{dataset}"] = " UNION ALL ".join(items)


ZIP_RE = r"(?i)(?:^|,\s*)([A-Za-z\s]+?)\s*,\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)\s*$"
CITY_RE = r"(?i)(?:^|,\s*)([A-Za-z\s]+?)\s*,\s*([A-Z]{2})\s*$"


def parsed(c: str) -> dict[str, str]:
    def part(pattern: str, group: int) -> str:
        return f"nullif(trim(regexp_extract({c}, '{pattern}', {group})), '')"

    return {
        "city": f"coalesce({part(ZIP_RE, 1)}, {part(CITY_RE, 1)})",
        "state": f"upper(coalesce({part(ZIP_RE, 2)}, {part(CITY_RE, 2)}))",
        "postal_code": part(ZIP_RE, 3),
    }


def gazetteer_values() -> str:
    from sparkprep.operators.geo import CITIES

    return "(VALUES " + ", ".join(f"('{c}', '{s}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for c, s, lat, lon in CITIES) + ") AS gz(gc, gs, glat, glon)"


def _geo(dataset: str) -> None:
    p = parsed("address_line_1") if "address_line_1" in columns(dataset) else dict.fromkeys(("city", "state", "postal_code"), "CAST(NULL AS VARCHAR)")
    VIEWS[f"parse_{dataset}"] = (
        f"SELECT *, {p['city']} AS p_city, {p['state']} AS p_state, {p['postal_code']} AS p_zip, "
        f"coalesce({p['postal_code']}, postal_code) AS eff FROM checked_{dataset}"
    )
    VIEWS[f"evidence_{dataset}"] = (
        f"SELECT postal_code AS e_zip, city AS e_city, state AS e_state, latitude AS e_lat, longitude AS e_lon FROM checked_{dataset} "
        f"WHERE postal_code IS NOT NULL AND (city IS NOT NULL OR state IS NOT NULL) "
        f"QUALIFY row_number() OVER (PARTITION BY postal_code ORDER BY _row_ord) = 1"
    )
    VIEWS[f"filled_{dataset}"] = (
        f"SELECT *, coalesce(city, p_city, e_city) AS f_city, coalesce(state, p_state, e_state) AS f_state, "
        f"coalesce(e_lat <> 0 AND e_lon <> 0, FALSE) AS located FROM parse_{dataset} LEFT JOIN evidence_{dataset} ON eff = e_zip"
    )
    VIEWS[f"placed_{dataset}"] = (
        f"SELECT f.*, glat, glon FROM filled_{dataset} f LEFT JOIN {gazetteer_values()} ON lower(trim(f_city)) = gc AND lower(trim(f_state)) = gs"
    )
    shared = "'Inferred {0} from record sharing postal code ''' || eff || '''.'"
    place = "'Geocoded {0} from city/state table for ''' || f_city || ', ' || f_state || ' ' || coalesce(eff, 'None') || '''.'"
    tries = []
    for f, pc, ec in (("city", "p_city", "e_city"), ("state", "p_state", "e_state")):
        tries.append((f, f"{f} IS NULL", f"coalesce({pc}, {ec})", f"CASE WHEN {pc} IS NOT NULL THEN 0.75 ELSE 0.9 END",
                      f"CASE WHEN {pc} IS NOT NULL THEN 'Parsed {f} from address_line_1.' ELSE {shared.format(f)} END"))
    tries.append(("postal_code", "postal_code IS NULL", "p_zip", "0.75", "'Parsed postal code from address_line_1.'"))
    for f, e, g in (("latitude", "e_lat", "glat"), ("longitude", "e_lon", "glon")):
        tries.append((f, f"{f} IS NULL", f"CASE WHEN located THEN {e} ELSE {g} END", "CASE WHEN located THEN 0.9 ELSE 0.7 END",
                      f"CASE WHEN located THEN {shared.format(f)} ELSE {place.format(f)} END"))
    VIEWS[f"review_{dataset}"] = " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset_name, '{RUN}' AS run_id, {record_id(dataset)} AS record_id, _row_ord, '{f}' AS field, "
        f"CAST({v} AS VARCHAR) AS candidate_value, CAST({conf} AS DOUBLE) AS confidence, {why} AS rationale, TRUE AS applied, "
        f"TRUE AS manual_review_required FROM placed_{dataset} WHERE {gap} AND ({v}) IS NOT NULL"
        for f, gap, v, conf, why in tries
    )
    touched = " OR ".join(f"({gap} AND ({v}) IS NOT NULL)" for _, gap, v, _, _ in tries)
    replaced = ", ".join(f"coalesce({f}, {v}) AS {f}" for f, _, v, _, _ in tries)
    VIEWS[f"gold_{dataset}"] = (
        f"SELECT * EXCLUDE (p_city, p_state, p_zip, eff, e_zip, e_city, e_state, e_lat, e_lon, f_city, f_state, located, glat, glon) "
        f"REPLACE ({replaced}, needs_review OR {touched} AS needs_review, "
        f"CASE WHEN {touched} THEN 'needs_review' ELSE row_status END AS row_status) FROM placed_{dataset}"
    )


for _ds in schema.DATASETS:
    VIEWS[f"raw_{_ds}"] = fixtures.raw_sql(_ds)
    VIEWS[f"typed_{_ds}"] = _typed(_ds)
    VIEWS[f"silver_{_ds}"] = (
        f"SELECT * FROM typed_{_ds} QUALIFY row_number() OVER (PARTITION BY {', '.join(schema.DEDUP_KEYS[_ds])} ORDER BY _row_ord) = 1"
    )
    VIEWS[f"direct_{_ds}"] = _direct(_ds)
    VIEWS[f"scoped_{_ds}"] = _scoped(_ds)
    VIEWS[f"checked_{_ds}"] = _checked(_ds)
    VIEWS[f"issues_{_ds}"] = _issues(_ds)
    if _ds in schema.GEO_DATASETS:
        _geo(_ds)
    if _ds in schema.TRANSACTIONALS:
        _xref(_ds)
VIEWS["gold_product_master"] = (
    "SELECT *, coalesce(product_id IN (SELECT product_id FROM silver_outbound_shipment_history WHERE direction = 'Outbound' AND product_id IS NOT NULL "
    "UNION SELECT product_id FROM silver_shipment_history WHERE direction = 'Outbound' AND product_id IS NOT NULL), FALSE) AS in_scope "
    "FROM checked_product_master"
)
for _log, _sets in (("issues", schema.DATASETS), ("review", schema.GEO_DATASETS), ("exceptions", schema.TRANSACTIONALS)):
    VIEWS[f"all_{_log}"] = " UNION ALL ".join(f"SELECT * EXCLUDE (_row_ord) FROM {_log}_{d}" for d in _sets)
