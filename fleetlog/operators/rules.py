"""Data-quality rules: raw string rows -> clean rows + an issues table.

Every row rule is a boolean column; the issues of a row are one
``explode(filter(array(when(rule, issue), ...), not null))`` in the rule
order the original emits them, so validation is a single narrow pass with no
shuffle.  Dataset rules (duplicates, odometer monotonicity) run on the
surviving rows with the tolerance join and the bucketed lag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.text import fixed, parse_iso_timestamp, parse_number, py_float, strip_ws, ts_text
from fleetlog.operators.pairs import tolerance_groups
from fleetlog.operators.sequence import DEFAULT_BUCKET, previous_row
from fleetlog.schema import (
    ALLOWED_FUEL_TYPES, COUNTRY_CODE_PATTERN, DUPLICATE_TOLERANCE_MINUTES, ERROR, KEY,
    PRICE_PER_LITER_MAX_WARN, PRICE_PER_LITER_MIN_WARN, PRIMARY_COUNTRY_CODES, ROW, TANK_FALSE_WORDS,
    TANK_STATES, TANK_TRUE_WORDS, TANK_UNKNOWN_WORDS, TS, WARNING,
)
from fleetlog.session import checkpoint_dir

ISSUE_FIELDS = ("dataset", "severity", "rule", "rule_seq", ROW, "field", "message")


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds and allowed values (defaults = the original tool's)."""

    price_min_warn: float = PRICE_PER_LITER_MIN_WARN
    price_max_warn: float = PRICE_PER_LITER_MAX_WARN
    fuel_types: tuple = ALLOWED_FUEL_TYPES
    primary_countries: tuple = PRIMARY_COUNTRY_CODES
    duplicate_minutes: float = DUPLICATE_TOLERANCE_MINUTES


@dataclass
class Validated:
    """Result of a validation: surviving rows and all issues (P10 helpers)."""

    good: DataFrame
    issues: DataFrame

    def errors(self) -> DataFrame:
        return self.issues.filter(F.col("severity") == ERROR)

    def warnings(self) -> DataFrame:
        return self.issues.filter(F.col("severity") == WARNING)


def _s(c: str) -> Column:
    """Raw cell as text; a missing cell (short CSV row) reads as ''."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _pylist(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def _sql_text(value: str) -> str:
    """An SQL string literal of any text."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _raw_sql(field: str) -> str:
    """SQL text of a raw cell; a missing cell reads as ''."""
    return f"coalesce(CAST({field} AS STRING), '')"


def _sql_list(values) -> str:
    return ", ".join(_sql_text(v) for v in values)


def _issue(dataset: str, severity: str, rule: str, seq: int, field: str | None, message_sql: str) -> str:
    """SQL text of one issue struct (``message_sql`` is an SQL string expression)."""
    f = f"'{field}'" if field else "CAST(NULL AS STRING)"
    return (f"named_struct('dataset', '{dataset}', 'severity', '{severity}', 'rule', '{rule}', 'rule_seq', {seq}, "
            f"'{ROW}', CAST({ROW} AS BIGINT), 'field', {f}, 'message', CAST({message_sql} AS STRING))")


def _explode_issues(df: DataFrame, keys: list[str], rules: list[tuple[str, str]], texts: dict[str, Column]) -> DataFrame:
    """One row per rule that fired, in rule order.

    ``rules`` are ``(condition SQL, issue SQL)`` pairs.  Only the rules' numbers are
    exploded; the issue of a number, its message and the ``texts`` that messages name are
    built behind the explode, for the rules that fired and no other row."""
    fired = ", ".join(f"CASE WHEN {cond} THEN {i} END" for i, (cond, _) in enumerate(rules))
    issue = "CASE _rule " + " ".join(f"WHEN {i} THEN {text}" for i, (_, text) in enumerate(rules)) + " END"
    found = df.select("*", F.expr(f"explode(array_compact(array({fired})))").alias("_rule")).withColumns(texts)
    return found.select(*keys, F.expr(issue).alias("_i")).select(*keys, *[F.col(f"_i.{f}").alias(f) for f in ISSUE_FIELDS])


def _number_issues(dataset: str, field: str, seq: int, positive: bool) -> list[tuple[str, str]]:
    """Not-numeric / out-of-range issues from the staged ``_<field>`` value."""
    num = f"_{field}"
    word = "positive" if positive else "non-negative"
    bad_range = f"{num} <= 0" if positive else f"{num} < 0"
    return [
        (f"{num} IS NULL", _issue(dataset, ERROR, f"{field}_not_numeric", seq, field,
                                  f"concat(\"Invalid numeric value for {field}: '\", {_raw_sql(field)}, \"'\")")),
        (f"{num} IS NOT NULL AND {bad_range}", _issue(dataset, ERROR, f"{field}_range", seq + 1, field,
                                                      f"concat('{field} must be {word}, got ', {num}_text)")),
    ]


def tank_state(c: Column, stripped_lower: bool = False) -> Column:
    """Tri-state full-tank parse; null when the text is not recognised (V5)."""
    v = c if stripped_lower else F.lower(strip_ws(c))
    return (F.when(v.isin(*TANK_UNKNOWN_WORDS), F.lit("unknown")).when(v.isin(*TANK_TRUE_WORDS), F.lit("true"))
            .when(v.isin(*TANK_FALSE_WORDS), F.lit("false")))


def validate_fuel_rows(raw: DataFrame, keys: list[str] | None = None, config: RuleConfig = RuleConfig(),
                       store: bool = False) -> tuple[DataFrame, DataFrame]:
    """Row rules for fuel rows (V1-V11).  ``raw`` holds the nine raw text columns
    plus ``row_num`` (and ``keys``).  Returns ``(parsed rows with row_ok, row issues)``;
    with ``store`` the rows are read and parsed once for both and written to the
    checkpoint folder.

    Three projections -- strip, parse, flag -- so every regular expression runs
    once per cell; the rule conditions only compare the staged columns.
    """
    keys = list(keys or [])
    ds = "fuel"
    c = F.col
    passthrough = [x for x in raw.columns if x not in keys and x != ROW]
    stripped = raw.select(
        *keys, c(ROW).cast("long").alias(ROW), *passthrough,
        strip_ws(_s("datetime")).alias("_dt_s"), strip_ws(_s("amount_eur")).alias("_am_s"),
        strip_ws(_s("liters")).alias("_li_s"), strip_ws(_s("fuel_type")).alias("_ftype"),
        F.lower(strip_ws(_s("is_full_tank"))).alias("_tk_s"), strip_ws(_s("station_name")).alias("_station"),
        strip_ws(_s("city")).alias("_city"), strip_ws(_s("country")).alias("_country"),
        strip_ws(_s("notes")).alias("_notes"))
    staged = stripped.select(
        "*", parse_iso_timestamp("_dt_s", stripped=True).alias("_ts"),
        parse_number("_am_s", stripped=True).alias("_amount_eur"),
        parse_number("_li_s", stripped=True).alias("_liters"),
        tank_state(c("_tk_s"), stripped_lower=True).alias("_tank"),
        c("_country").rlike(COUNTRY_CODE_PATTERN).alias("_country_ok")).drop("_dt_s", "_am_s", "_li_s", "_tk_s")
    row_ok = (c("_ts").isNotNull() & (c("_amount_eur") > 0) & (c("_liters") > 0)
              & c("_ftype").isin(*config.fuel_types) & c("_tank").isNotNull() & (c("_station") != "")
              & c("_country_ok"))
    parsed = staged.withColumns({"row_ok": F.coalesce(row_ok, F.lit(False)), "_amount": c("_amount_eur")})
    texts = {"_amount_eur_text": py_float("_amount_eur"), "_liters_text": py_float("_liters"),
             "_price_text": fixed(F.try_divide("_amount_eur", "_liters"), 3)}
    tank_ok = "_tank IS NOT NULL"
    price = "(_amount / _liters)"
    rules = [
        ("_ts IS NULL", _issue(ds, ERROR, "datetime_unparsable", 1, "datetime",
                               f"concat(\"Unparsable datetime: '\", {_raw_sql('datetime')}, \"'\")")),
    ]
    rules += _number_issues(ds, "amount_eur", 2, True) + _number_issues(ds, "liters", 4, True)
    rules += [
        (f"NOT _ftype IN ({_sql_list(config.fuel_types)})",
         _issue(ds, ERROR, "fuel_type_invalid", 6, "fuel_type",
                f"concat(\"Invalid fuel_type: '\", _ftype, {_sql_text(f"'. Allowed: {_pylist(config.fuel_types)}")})")),
        (f"NOT ({tank_ok})", _issue(ds, ERROR, "full_tank_invalid", 7, "is_full_tank",
                                    f"concat(\"Invalid full tank value: '\", {_raw_sql('is_full_tank')}, "
                                    f"\"'. Expected true/false/empty or yes/no/1/0.\")")),
        # V6-V10 are not evaluated for a row whose tank value is invalid.
        (f"{tank_ok} AND _station = ''", _issue(ds, ERROR, "station_missing", 8, "station_name",
                                                "'Missing station_name'")),
        (f"{tank_ok} AND _city = ''", _issue(ds, WARNING, "city_missing", 9, "city", "'Missing city value'")),
        (f"{tank_ok} AND NOT _country_ok",
         _issue(ds, ERROR, "country_format", 10, "country",
                "concat(\"Invalid country code format: '\", _country, \"'. Expected 2-letter ISO code.\")")),
        (f"{tank_ok} AND _country_ok AND NOT _country IN ({_sql_list(config.primary_countries)})",
         _issue(ds, WARNING, "country_not_primary", 11, "country",
                f"concat(\"Country '\", _country, {_sql_text(f"' is not in the primary set {_pylist(config.primary_countries)}")})")),
        (f"row_ok AND {price} < {config.price_min_warn}",
         _issue(ds, WARNING, "price_low", 12, "amount_eur",
                f"concat('Suspiciously low derived price per liter: ', _price_text, ' EUR')")),
        (f"row_ok AND {price} > {config.price_max_warn}",
         _issue(ds, WARNING, "price_high", 13, "amount_eur",
                f"concat('Suspiciously high derived price per liter: ', _price_text, ' EUR')")),
    ]
    if store:
        parsed = _stored(parsed)
    return parsed, _explode_issues(parsed, keys, rules, texts)


def _stored(parsed: DataFrame) -> DataFrame:
    """Parsed rows computed once, in the shared checkpoint folder."""
    checkpoint_dir(parsed.sparkSession)
    return parsed.checkpoint(eager=True)


def surviving(parsed: DataFrame, cols: list[Column]) -> DataFrame:
    """Rows with ``row_ok``, projected to ``cols``.

    Written as a generator over a zero-or-one element array rather than a
    ``filter``: Catalyst pushes a filter below the staged projections and
    inlines every parse into one predicate (each regex then runs twice per
    cell); a predicate cannot move below a generator.
    """
    one = F.array_compact(F.array(F.when(F.col("row_ok"), F.struct(*cols))))
    return parsed.select(F.explode(one).alias("_g")).select("_g.*")


def fuel_good_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return surviving(parsed, [
        *[c(k) for k in keys], c("_ts").alias(TS), c("_amount").alias("amount_eur"), c("_liters").alias("liters"),
        (c("_amount") / c("_liters")).alias("price_per_liter_eur"),
        c("_ftype").alias("fuel_type"), c("_tank").alias("is_full_tank"),
        c("_station").alias("station_name"), c("_city").alias("city"),
        c("_country").alias("country"), c("_notes").alias("notes"), c(ROW)])


def fuel_duplicates(good: DataFrame, keys: list[str] | None = None,
                    tolerance_minutes: float = DUPLICATE_TOLERANCE_MINUTES) -> DataFrame:
    """Instants of surviving fuel rows with equal litres within the tolerance (V13, J2),
    one row for each instant with its nearest earlier partner and its pair count."""
    return tolerance_groups(good, list(keys or []), ["liters"], tolerance_minutes=tolerance_minutes)


def _duplicate_issues(groups: DataFrame, keys: list[str], dataset: str, seq: int, what: Column, minutes: float) -> DataFrame:
    """One issue for each instant with partners; ``pairs`` counts the pairs it stands for."""
    partner = F.coalesce(F.col("nearest_ts"), F.col(TS))
    return groups.select(*keys, F.lit(dataset).alias("dataset"), F.lit(WARNING).alias("severity"),
                         F.lit("potential_duplicate").alias("rule"), F.lit(seq).alias("rule_seq"),
                         F.lit(None).cast("long").alias(ROW), F.lit(None).cast("string").alias("field"),
                         F.concat(what, ts_text(partner), F.lit(" and "), ts_text(TS),
                                  F.lit(f" (within {_tolerance_text(minutes)})")).alias("message"),
                         F.coalesce("nearest_row", "first_row").alias("pair_row_a"), F.col("last_row").alias("pair_row_b"),
                         "pairs")


def _tolerance_text(minutes: float) -> str:
    total = int(round(minutes * 60))
    return f"{total // 3600}:{total % 3600 // 60:02d}:{total % 60:02d}"


def _single(issues: DataFrame) -> DataFrame:
    """Row issues with the columns of pair issues; each stands for itself."""
    none = F.lit(None).cast("long")
    return issues.withColumns({"pair_row_a": none, "pair_row_b": none, "pairs": F.lit(1).cast("long")})


def validate_fuel(raw: DataFrame, keys: list[str] | None = None, config: RuleConfig = RuleConfig(),
                  store: bool = False) -> Validated:
    """Row rules, then the duplicate rule on surviving rows (V1-V13, V17).  ``store``: see
    ``validate_fuel_rows``."""
    keys = list(keys or [])
    parsed, row_issues = validate_fuel_rows(raw, keys, config, store)
    good = fuel_good_rows(parsed, keys)
    what = F.concat(F.lit("Potential duplicate: rows with "), py_float("liters"), F.lit("L at "))
    dup = _duplicate_issues(fuel_duplicates(good, keys, config.duplicate_minutes), keys, "fuel", 20, what,
                            config.duplicate_minutes)
    issues = _single(row_issues).unionByName(dup)
    return Validated(good, issues)


def validate_odometer_rows(raw: DataFrame, keys: list[str] | None = None, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """Row rules for odometer rows (V1, V3, V12), staged like the fuel rules."""
    keys = list(keys or [])
    ds = "odometer"
    c = F.col
    passthrough = [x for x in raw.columns if x not in keys and x != ROW]
    stripped = raw.select(*keys, c(ROW).cast("long").alias(ROW), *passthrough,
                          strip_ws(_s("datetime")).alias("_dt_s"), strip_ws(_s("odometer_km")).alias("_km_s"),
                          strip_ws(_s("notes")).alias("_notes"))
    staged = stripped.select("*", parse_iso_timestamp("_dt_s", stripped=True).alias("_ts"),
                             parse_number("_km_s", stripped=True).alias("_odometer_km")).drop("_dt_s", "_km_s")
    parsed = staged.withColumn("row_ok", F.coalesce(c("_ts").isNotNull() & (c("_odometer_km") >= 0), F.lit(False)))
    rules = [("_ts IS NULL", _issue(ds, ERROR, "datetime_unparsable", 1, "datetime",
                                    f"concat(\"Unparsable datetime: '\", {_raw_sql('datetime')}, \"'\")"))]
    rules += _number_issues(ds, "odometer_km", 2, False)
    if store:
        parsed = _stored(parsed)
    return parsed, _explode_issues(parsed, keys, rules, {"_odometer_km_text": py_float("_odometer_km")})


def odometer_monotonicity(good: DataFrame, keys: list[str] | None = None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Adjacent readings (time order, ties by row) where the odometer goes down."""
    keys = list(keys or [])
    d = previous_row(good, keys, {"ts": F.col(TS), "n": F.col(ROW), "km": F.col("odometer_km")}, "_prev",
                     bucket=bucket)
    return d.filter(F.col("odometer_km") < F.col("_prev.km")).select(
        *keys, TS, ROW, "odometer_km", F.col("_prev.ts").alias("previous_ts"),
        F.col("_prev.n").alias("previous_row_num"), F.col("_prev.km").alias("previous_km"))


def odometer_duplicates(good: DataFrame, keys: list[str] | None = None, equal: list[str] | None = None,
                        tolerance_minutes: float = DUPLICATE_TOLERANCE_MINUTES) -> DataFrame:
    """Instants of readings with the same km within the tolerance (V15, J2), like ``fuel_duplicates``."""
    return tolerance_groups(good, list(keys or []), list(equal or ["odometer_km"]), tolerance_minutes=tolerance_minutes)


def validate_odometer(raw: DataFrame, keys: list[str] | None = None,
                      config: RuleConfig = RuleConfig(), bucket=DEFAULT_BUCKET, store: bool = False) -> Validated:
    """Row rules, then monotonicity and duplicates on surviving rows.
    ``store``: see ``validate_fuel_rows``."""
    keys = list(keys or [])
    parsed, row_issues = validate_odometer_rows(raw, keys, store)
    good = surviving(parsed, [*[F.col(k) for k in keys], F.col("_ts").alias(TS),
                              F.col("_odometer_km").alias("odometer_km"), F.col("_notes").alias("notes"), F.col(ROW)])
    mono = odometer_monotonicity(good, keys, bucket).select(
        *keys, F.lit("odometer").alias("dataset"), F.lit(WARNING).alias("severity"),
        F.lit("monotonicity").alias("rule"), F.lit(20).alias("rule_seq"), F.lit(None).cast("long").alias(ROW),
        F.lit("odometer_km").alias("field"),
        F.concat(F.lit("Odometer monotonicity violation: "), py_float("odometer_km"), F.lit(" km at "),
                 ts_text(TS), F.lit(" is less than "), py_float("previous_km"), F.lit(" km at "),
                 ts_text("previous_ts")).alias("message"),
        F.col("previous_row_num").alias("pair_row_a"), F.col(ROW).alias("pair_row_b"))
    what = F.concat(F.lit("Potential duplicate: odometer readings of "), py_float("odometer_km"), F.lit(" km at "))
    dups = _duplicate_issues(odometer_duplicates(good, keys, tolerance_minutes=config.duplicate_minutes), keys, "odometer",
                             21, what, config.duplicate_minutes)
    issues = _single(row_issues).unionByName(mono.withColumn("pairs", F.lit(1).cast("long"))).unionByName(dups)
    return Validated(good, issues)


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issue counts per dataset, severity and rule (V16, A13); a duplicate issue counts
    the pairs that it stands for."""
    return issues.groupBy("dataset", "severity", "rule").agg(F.sum("pairs").alias("issues"))


def issue_lines(issues: DataFrame) -> DataFrame:
    """One summary line per issue: ``  [ERROR] row 5: ...`` / ``  [WARN] dataset: ...``."""
    prefix = F.when(F.col("severity") == ERROR, F.lit("ERROR")).otherwise(F.lit("WARN"))
    loc = F.when(F.col(ROW).isNotNull() & (F.col(ROW) != 0), F.concat(F.lit("row "), F.col(ROW).cast("string"))) \
        .otherwise(F.lit("dataset"))
    return issues.withColumn("line", F.concat(F.lit("  ["), prefix, F.lit("] "), loc, F.lit(": "), F.col("message")))


def quality_summary(fuel: Validated, odometer: Validated) -> DataFrame:
    """Valid-record counts, error and warning counts and pass/fail per log.

    One aggregation over the union of issue rows and good rows per log."""
    def tagged(name: str, v: Validated) -> DataFrame:
        return (v.issues.select(F.lit(name).alias("dataset"), "severity", "pairs", F.lit(0).alias("_good"))
                .unionByName(v.good.select(F.lit(name).alias("dataset"), F.lit(None).cast("string").alias("severity"),
                                           F.lit(0).cast("long").alias("pairs"), F.lit(1).alias("_good"))))
    return (tagged("fuel", fuel).unionByName(tagged("odometer", odometer)).groupBy("dataset")
            .agg(F.sum("_good").cast("long").alias("valid_records"),
                 F.sum(F.when(F.col("severity") == ERROR, F.col("pairs")).otherwise(0)).alias("errors"),
                 F.sum(F.when(F.col("severity") == WARNING, F.col("pairs")).otherwise(0)).alias("warnings"))
            .withColumn("is_valid", F.col("errors") == 0))


# ---------------------------------------------------------------------------
# Entry-form profile (V18) and client-side decimal clean-up
# ---------------------------------------------------------------------------

def clean_decimal(c: Column) -> Column:
    """Decimal comma -> point (first comma only), then round half up to 2 decimals."""
    x = F.regexp_replace(c.cast("string"), r"^([^,]*),", "$1.").try_cast("double")
    return F.floor(x * 100 + 0.5) / 100


def clean_entries(entries: DataFrame) -> DataFrame:
    """The form's decimal clean-up of ``liters`` and ``amount_eur`` (V19); text that is no
    number stays as it is, for the rules to reject."""
    def cleaned(field: str) -> Column:
        return F.coalesce(clean_decimal(F.col(field)).cast("string"), F.col(field).cast("string"))
    return entries.withColumns({field: cleaned(field) for field in ("liters", "amount_eur")})


def validate_entries(entries: DataFrame, keys: list[str] | None = None, config: RuleConfig = RuleConfig(),
                     clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entry-form rules: whole record rejected on any error (V18); ``clean`` runs V19 first.

    Input columns: station_name, city, country, liters, amount_eur, entry_date,
    fuel_type, is_full_tank, notes (+ keys, row_num).  Returns ``(accepted,
    rejected)``; accepted rows carry ``warnings`` (array of price warnings),
    rejected rows all their input columns and an ``errors`` map field -> message.
    """
    keys = list(keys or [])
    judged = judge_entries(entries, config, clean)
    return accepted_entries(judged, keys, config), rejected_entries(judged, entries.columns)


def judge_entries(entries: DataFrame, config: RuleConfig = RuleConfig(), clean: bool = False) -> DataFrame:
    """``entries`` with their parsed cells (``_v``) and the list of their errors (``_errs``).

    Cells are parsed behind a generator, which no predicate or projection moves
    through, so each regular expression stands once in the plan."""
    entries = clean_entries(entries) if clean else entries
    cells = entries.select("*", F.struct(
        strip_ws(_s("station_name")).alias("station_name"), strip_ws(_s("city")).alias("city"),
        F.upper(strip_ws(_s("country"))).alias("country"), strip_ws(_s("fuel_type")).alias("fuel_type"),
        F.lower(strip_ws(F.coalesce(F.col("is_full_tank").cast("string"), F.lit("unknown")))).alias("is_full_tank"),
        strip_ws(_s("notes")).alias("notes"), strip_ws(_s("liters")).alias("liters"), strip_ws(_s("amount_eur")).alias("amount_eur"),
        strip_ws(_s("entry_date")).alias("entry_date")).alias("_c"))
    texts = ("station_name", "city", "country", "fuel_type", "is_full_tank", "notes")
    cells = cells.select(*entries.columns, F.explode(F.array("_c")).alias("_c"))
    parsed = F.struct(*[F.col("_c")[t].alias(t) for t in texts], F.col("_c.country").rlike(COUNTRY_CODE_PATTERN).alias("country_ok"),
                      parse_number(F.col("_c.liters"), stripped=True).alias("liters"),
                      parse_number(F.col("_c.amount_eur"), stripped=True).alias("amount_eur"),
                      parse_iso_timestamp(F.col("_c.entry_date"), stripped=True).alias(TS))
    staged = cells.select(*entries.columns, F.explode(F.array(parsed)).alias("_v"))
    v = F.col("_v")
    checks = [
        ("station_name", v["station_name"] == "", "Required."),
        ("city", v["city"] == "", "Required."),
        ("country", ~v["country_ok"], "Must be a 2-letter ISO country code."),
        ("liters", F.coalesce(v["liters"] <= 0, F.lit(True)), "Must be greater than 0."),
        ("amount_eur", F.coalesce(v["amount_eur"] <= 0, F.lit(True)), "Must be greater than 0."),
        ("fuel_type", ~v["fuel_type"].isin(*config.fuel_types), f"Must be one of {_pylist(config.fuel_types)}."),
        ("is_full_tank", ~v["is_full_tank"].isin(*TANK_STATES), "Must be true, false, or unknown."),
        ("entry_date", v[TS].isNull(), "Must be a valid date/time."),
    ]
    errs = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message")))
                                     for f, bad, m in checks]))
    return staged.select("*", errs.alias("_errs"))


def accepted_entries(judged: DataFrame, keys: list[str], config: RuleConfig = RuleConfig()) -> DataFrame:
    """The entries without errors as fuel rows, with ``warnings``."""
    number = [ROW] if ROW in judged.columns else []
    v = F.col("_v")
    # the price behind a generator too: its text names it many times
    one = F.struct(*[v[f].alias(f) for f in (TS, "amount_eur", "liters", "fuel_type", "is_full_tank", "station_name", "city", "country", "notes")],
                   F.try_divide(v["amount_eur"], v["liters"]).alias("price_per_liter_eur"))
    rows = judged.filter(F.size("_errs") == 0).select(*keys, *number, F.inline(F.array(one)))
    price = F.col("price_per_liter_eur")
    odd = F.when(price < config.price_min_warn, F.lit("low")).when(price > config.price_max_warn, F.lit("high"))
    text = F.concat(F.lit("Derived price per liter ("), fixed(price, 3), F.lit(" EUR/L) is suspiciously "), odd, F.lit("."))
    warnings = F.array_compact(F.array(F.when(odd.isNotNull(), text)))
    return rows.select(*[c for c in rows.columns if c != "price_per_liter_eur"], warnings.alias("warnings"), "price_per_liter_eur")


def rejected_entries(judged: DataFrame, columns: list[str]) -> DataFrame:
    """The entries with errors as entered, with the map ``errors``."""
    return judged.filter(F.size("_errs") > 0).select(*columns, F.map_from_entries("_errs").alias("errors"))
