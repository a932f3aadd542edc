"""Domain tables derived from the given star-schema tables, in SQL that Spark and DuckDB share.

Each view's text names other views; ``view`` builds a Spark DataFrame, ``prelude`` the same as the
common table expressions of an oracle query. Integer arithmetic only, so both engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_YM = "lpad(cast(cast(floor(({0}) / 12) as bigint) as string), 4, '0') || lpad(cast(({0}) % 12 + 1 as string), 2, '0')"


def ym(expr: str) -> str:
    """Month key AAAAMM of a month index."""
    return _YM.format(expr)


def _money(cents: str) -> str:
    return f"cast(cast({cents} as decimal(18,0)) * cast('0.01' as decimal(3,2)) as decimal(20,2))"


CUTOFF = "timestamp '2024-03-01 00:00:00'"
_EARLY, _LATE = "timestamp '2024-01-10 00:00:00'", "timestamp '2024-06-01 00:00:00'"

VIEWS: dict[str, str] = {
    "items": """select *, l_orderkey + 7*l_linenumber + 13*l_partkey + 17*l_suppkey as h,
        cast(year(l_shipdate) as bigint)*12 + month(l_shipdate) - 1 as mi, cast(round(l_extendedprice*100) as bigint) as cents,
        cast(l_quantity as bigint) as qty, l_partkey % 50 as p, (7*l_partkey + 3*l_suppkey) % 12 as o,
        (l_orderkey + 7*l_linenumber + 13*l_partkey + 17*l_suppkey) % 10 as code from lineitem""",
    "amounts": """select *, case when code in (0,1) then 0 when code = 2 then qty - cast(floor(qty / 4) as bigint) else qty end + case when h % 29 = 0 then 1 else 0 end as qty_ok,
        case when code in (0,1) then 0 when code = 2 then cents - cast(floor(cents / 4) as bigint) else cents end + case when h % 29 = 0 then 1 else 0 end as cents_ok from items""",
    "production": f"""select 'art_sia_' || {ym('mi')} || '_' || case when h % 2 = 0 then 'a' else 'b' end || '#' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || '_' || cast(l_partkey as string) || '_' || cast(l_suppkey as string) || '_' || cast(year(l_shipdate)*10000 + month(l_shipdate)*100 + day(l_shipdate) as string) || '_' || cast(cents as string) as row_id,
        'art_sia_' || {ym('mi')} || '_' || case when h % 2 = 0 then 'a' else 'b' end as artifact_id,
        h % 53 = 0 as deletado,
        case when h % 61 = 0 then null when h % 67 = 0 then 'Z' when l_returnflag = 'A' and l_linestatus = 'F' then 'C' when l_returnflag = 'A' then 'I' when l_returnflag = 'N' and l_linestatus = 'F' then 'P' when l_returnflag = 'N' then 'S' when l_linestatus = 'F' then 'A' else 'B' end as instrumento_bruto,
        case when h % 41 = 0 then null when h % 43 = 0 then 'X' || cast(p as string) else lpad(cast(p as string), 10, '0') end as procedimento_bruto,
        case when h % 47 = 0 then null else lpad(cast(o as string), 6, '0') end as cbo_bruto,
        lpad(cast(l_suppkey as string), 7, '0') as cnes,
        case when h % 71 = 0 then null else cast(350000 + l_suppkey % 25 as string) end as municipio_estabelecimento,
        {ym('mi')} as competencia_processamento,
        case when h % 59 = 0 then null when h % 89 = 0 then {ym('mi + 1')} else {ym('mi - h % 4')} end as competencia_atendimento,
        qty as quantidade_apresentada, {_money('cents')} as valor_apresentado,
        case when code in (0,1) then '0' when code = 2 then '6' when code = 3 then '9' else '5 ' end as pa_indica_bruto,
        qty_ok as quantidade_aprovada, {_money('cents_ok')} as valor_aprovado, mi, p, o, h, l_suppkey from amounts""",
    # the raw codes, with those outside their domain as null
    "records": """select row_id, artifact_id, deletado, case when instrumento_bruto in ('C','I','P','S','A','B') then instrumento_bruto end as instrumento,
        case when length(procedimento_bruto) = 10 then procedimento_bruto end as procedimento, cbo_bruto as cbo, cnes, municipio_estabelecimento,
        competencia_processamento, competencia_atendimento, quantidade_apresentada, valor_apresentado, pa_indica_bruto, quantidade_aprovada, valor_aprovado from production""",
    "months": f"select distinct mi, {ym('mi')} as competencia from items",
    "proc_occ": f"""select distinct 'art_sig_' || {ym('mi')} as artifact_id, {ym('mi')} as dt_competencia, lpad(cast(p as string), 10, '0') as co_procedimento,
        case when mi % 9 = 4 and p % 10 = 0 and o % 6 = 5 then null else lpad(cast(o as string), 6, '0') end as co_ocupacao
        from items where (31*p + 17*o + mi) % 6 <> 0 and (p + mi) % 23 <> 0""",
    "estab_occ": f"""select 'art_pf_' || {ym('mi')} || case when l_suppkey % 2 = 0 then '_a' else '_b' end as artifact_id, {ym('mi')} as competencia_arquivo, lpad(cast(l_suppkey as string), 7, '0') as cnes, lpad(cast(o as string), 6, '0') as cbo,
        case when (l_suppkey + o + mi) % 13 = 12 then null when (l_suppkey + o + mi) % 10 = 0 then 0 else count(*) end as n_vinculos
        from items where (l_suppkey + mi) % 19 <> 0 group by mi, l_suppkey, o""",
    "instr_codes": """select p, mi, case when l_returnflag = 'A' and l_linestatus = 'F' then 1 when l_returnflag = 'A' then 2 when l_returnflag = 'N' and l_linestatus = 'F' then 6 when l_returnflag = 'N' then 7 when l_linestatus = 'F' then 8 else 9 end as c from items""",
    "proc_instr": f"""select distinct 'art_sig_' || {ym('mi')} as artifact_id, {ym('mi')} as dt_competencia, lpad(cast(p as string), 10, '0') as co_procedimento, lpad(cast(c as string), 2, '0') as co_registro
        from instr_codes where (p + mi + c) % 5 <> 0 and (p + mi) % 23 <> 0""",
    "proc": f"select distinct 'art_sig_' || {ym('mi')} as artifact_id, {ym('mi')} as dt_competencia, lpad(cast(p as string), 10, '0') as co_procedimento from items where (p + mi) % 8 <> 0",
    # one observation a month of the first source, by the first rule that holds; two parts of the second
    "sig_kind": "select mi, competencia, case when mi % 7 = 3 then 'none' when mi % 11 = 5 then 'two' when mi % 13 = 6 then 'bad' when mi % 17 = 8 then 'late' else 'one' end as kind from months",
    "observations": f"""select 'ob_sig_' || competencia as observation_id, 'sig' as fonte, competencia, cast(null as string) as parte, case when kind = 'late' then {_LATE} else {_EARLY} end as observado_em,
        case when kind = 'none' then 'NAO_ENCONTRADO' else 'OBTIDO' end as resultado, case when kind <> 'none' then 'art_sig_' || competencia end as artifact_id from sig_kind
        union all select 'ob_sig_' || competencia || '_r', 'sig', competencia, cast(null as string), timestamp '2024-02-10 00:00:00', 'OBTIDO', 'art_sig_' || competencia || '_r' from sig_kind where kind = 'two'
        union all select 'ob_pf_' || competencia || '_a', 'pf', competencia, 'a', {_EARLY}, 'OBTIDO', 'art_pf_' || competencia || '_a' from months
        union all select 'ob_pf_' || competencia || '_b', 'pf', competencia, 'b', {_EARLY}, 'OBTIDO', 'art_pf_' || competencia || '_b' from months where mi % 19 <> 9""",
    "versions": """select distinct o.artifact_id, case when k.kind = 'bad' and o.fonte = 'sig' then 'QUARENTENA_HASH' else 'OK' end as estado from observations o join sig_kind k on o.competencia = k.competencia where o.artifact_id is not null
        union all select distinct artifact_id, case when mi % 29 = 7 and h % 2 = 0 then 'QUARENTENA_HASH' else 'OK' end as estado from production""",
    "expected_parts": "select 'pf' as fonte, competencia, 'a' as parte from months union all select 'pf', competencia, 'b' from months",
}
# The rules, their source of reference data, the month it is asked for, and the families' names.
RULE_ROWS = [
    ("PROC_CBO_SIGTAP", "PROCEDIMENTO_CBO", "sig", "PROCESSAMENTO", 0),
    ("ESTAB_CBO_CNES", "ESTABELECIMENTO_CBO", "pf", "PROCESSAMENTO", 0),
    ("INSTRUMENTO_REGISTRO_SIGTAP", "INSTRUMENTO_REGISTRO", "sig", "ATENDIMENTO", 0),
    ("VIGENCIA_PROCEDIMENTO_SIGTAP", "VIGENCIA_PROCEDIMENTO", "sig", "PROCESSAMENTO", -1),
]
INSTRUMENTS = {"C": "01", "I": "02", "P": "06", "S": "07", "A": "08", "B": "09"}
# End of the fixed values.
_TABLES = ("lineitem", "orders", "events")
#: The columns of the lines that the views use.
USED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")


def _needs(text: str, names: list[str]) -> list[str]:
    words = set(re.findall(r"(?:from|join)\s+(\w+)", text))
    return [n for n in names if n in words]


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The Spark DataFrame of a view; views in ``given`` are taken from there."""
    if given and name in given:
        return given[name]
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n, given) for n in _needs(text, [*VIEWS, *_TABLES])}
    for n in inputs:
        text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **inputs)


def prelude(**more: str) -> str:
    """WITH clause of all views, and of ``more``."""
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in {**VIEWS, **more}.items()) + "\n"
