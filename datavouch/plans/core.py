"""The validation flow on the adapter's tables: inputs, selections, coverage, evaluation, aggregates.

``Flow`` builds each step lazily and keeps the DataFrames of one call; ``ORACLE`` has the same steps
as DuckDB common table expressions, written in another form (EXISTS tests, grouped lists).
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavouch.functions.months import month_index
from datavouch.functions.tables import bound_broadcasts, spread, written
from datavouch.operators import coverage, labels, metrics, rules, temporal
from datavouch.plans import adapter
from datavouch.plans.adapter import CUTOFF, INSTRUMENTS, RULE_ROWS

_MAP = tuple(INSTRUMENTS.items())
RULES = [
    rules.Rule(*RULE_ROWS[0], record_key=("procedimento", "cbo"), aux_key=("co_procedimento", "co_ocupacao"), no_leading="APLICABILIDADE_DESCONHECIDA"),
    rules.Rule(*RULE_ROWS[1], record_key=("cnes", "cbo"), aux_key=("cnes", "cbo"), no_leading="COBERTURA_INSUFICIENTE", positive="n_vinculos", month_column="competencia_arquivo"),
    rules.Rule(*RULE_ROWS[2], record_key=("procedimento", "co_registro"), aux_key=("co_procedimento", "co_registro"), no_leading="COBERTURA_INSUFICIENTE", mapping=_MAP),
    rules.Rule(*RULE_ROWS[3], record_key=("procedimento",), aux_key=("co_procedimento",), instruments=("C", "I", "P", "S", "A")),
]
EVALUATED = ("row_id", "artifact_id", "instrumento", "procedimento", "cbo", "cnes", "competencia_processamento", "competencia_atendimento", "quantidade_apresentada")
_RULE_IDS = [r.rule_id for r in RULES]
AUX_VIEW = dict(zip((r.rule_id for r in RULES), ("proc_occ", "estab_occ", "proc_instr", "proc"), strict=True))
SPLIT = {"desenvolvimento": ("199501", "199712"), "calibracao": ("199801", "199906"), "teste": ("199907", "200112")}


class Flow:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._aux: dict[str, DataFrame] = {}
        self._coverage: dict[str, DataFrame] = {}
        self._one_rule: dict[int, DataFrame] = {}

    @cached_property
    def items(self) -> DataFrame:
        """What all tables are derived from. Where its file has too few parts, the columns that are used are
        dealt out and stored; what is derived from them is made in every step anew."""
        lines = adapter.view(self.spark, self.sf_dir, "lineitem").select(*adapter.USED)
        wide = spread(lines, "l_orderkey", "l_linenumber")
        return adapter.view(self.spark, self.sf_dir, "items", {"lineitem": lines if wide is lines else written(wide)})

    def view(self, name: str) -> DataFrame:
        return adapter.view(self.spark, self.sf_dir, name, {} if name == "items" else {"items": self.items})

    def _by_month(self, name: str) -> DataFrame:
        """A view that needs the months alone: they are few, and read from where they were written."""
        return adapter.view(self.spark, self.sf_dir, name, {"months": self._months})

    @cached_property
    def _months(self) -> DataFrame:
        return written(self.view("months"))

    @cached_property
    def records(self) -> DataFrame:
        """The canonical records. Each is made from one line alone, so a step that needs a few columns makes
        them for less than it would write and read."""
        return self.view("records")

    @cached_property
    def stored_records(self) -> DataFrame:
        """What evaluations read of the records: made in one stage with an evaluation, they would need
        methods of generated code beyond what can be compiled."""
        return written(self.records.select(*EVALUATED), "records")

    @cached_property
    def obs(self) -> DataFrame:
        return written(self._by_month("observations"))

    @cached_property
    def versions(self) -> DataFrame:
        return written(adapter.view(self.spark, self.sf_dir, "versions", {"months": self._months, "observations": self.obs}))

    @cached_property
    def cutoff(self):
        return F.expr(CUTOFF)

    @cached_property
    def rule_table(self) -> DataFrame:
        return self.spark.createDataFrame([(r.rule_id, r.family, r.source, r.base, r.offset) for r in RULES], "rule_id string, familia string, fonte string, base string, deslocamento int")

    @cached_property
    def sources(self) -> DataFrame:
        return temporal.rule_sources(self.rule_table, self.rule_table.select("fonte", "base", "deslocamento"))

    @cached_property
    def required(self) -> DataFrame:
        return temporal.required_months(self.records, self.sources)

    @cached_property
    def parts(self) -> DataFrame:
        return temporal.resolve_parts(self.obs, self.versions, self.cutoff)

    @cached_property
    def decided(self) -> DataFrame:
        return written(temporal.combine_parts(self.parts, self._by_month("expected_parts")))

    @cached_property
    def selections(self) -> DataFrame:
        return temporal.join_decisions(self.required, self.decided)

    def aux(self, rule_id: str) -> DataFrame:
        """The reference table of a rule, stored as it would be where it is not derived."""
        if rule_id not in self._aux:
            self._aux[rule_id] = written(self.view(AUX_VIEW[rule_id]))
        return self._aux[rule_id]

    @cached_property
    def months(self) -> DataFrame:
        return self._months.select("competencia")

    @cached_property
    def families(self) -> DataFrame:
        return self.spark.createDataFrame([(r.family, i) for r in RULES for i in r.instruments], "familia_regra string, instrumento string")

    def _available(self, chosen: list[rules.Rule]) -> DataFrame:
        parts = []
        for r in chosen:
            aux, n = self.aux(r.rule_id), self.families.filter(F.col("familia_regra") == r.family)
            if r.mapping:
                code = self.spark.createDataFrame(list(r.mapping), "instrumento string, codigo string")
                have = coverage.available_months(aux, r.month_column, r.aux_key, code="co_registro").join(F.broadcast(code), "codigo")
                parts.append(n.join(have.select("instrumento", "competencia"), "instrumento").select("familia_regra", "instrumento", "competencia"))
            else:
                parts.append(n.crossJoin(coverage.available_months(aux, r.month_column, r.aux_key)))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def places(self) -> DataFrame:
        """The territory: a list of municipalities, as one would be given."""
        m = F.col("municipio_estabelecimento")
        return self.records.filter(m.isNotNull()).select(m.alias("codigo")).distinct().filter(F.col("codigo").cast("int") % 7 != 0)

    @cached_property
    def outcomes(self) -> DataFrame:
        """The outcomes of all rules and of the first alone. Not stored: a row a record and method."""
        return metrics.rule_outcomes(self.evaluations, {"regras": _RULE_IDS, "par": _RULE_IDS[:1]})

    @cached_property
    def available(self) -> DataFrame:
        return self._available(RULES)

    def _cover(self, chosen: list[rules.Rule]) -> DataFrame:
        """The coverage matrix of the families of some rules."""
        key, every = (",".join(r.rule_id for r in x) for x in (chosen, RULES))
        if every in self._coverage:
            return self._coverage[every]
        if key not in self._coverage:
            bases = self.spark.createDataFrame([("PROCESSAMENTO",), ("ATENDIMENTO",)], "base_temporal string")
            families = self.families.filter(F.col("familia_regra").isin([r.family for r in chosen]))
            self._coverage[key] = written(coverage.build_coverage(self.records, self._available(chosen), families, self.months, bases))
        return self._coverage[key]

    @cached_property
    def coverage(self) -> DataFrame:
        return self._cover(RULES)

    @cached_property
    def evaluations(self) -> DataFrame:
        """Not stored, as four rows a record are several times the input: each step makes anew the columns
        that it needs."""
        aux = {r.rule_id: self.aux(r.rule_id) for r in RULES}
        return rules.evaluate_rules(RULES, self.stored_records, aux, self.decided, self.coverage, self.versions, keep=("quantidade_apresentada",))

    @cached_property
    def stored_evaluations(self) -> DataFrame:
        """For steps that read the evaluations more than twice."""
        return written(self.evaluations)

    @cached_property
    def aggregates(self) -> DataFrame:
        return rules.aggregate_records(self.evaluations, known=_RULE_IDS)

    @cached_property
    def labels(self) -> DataFrame:
        return labels.label_records(self.records)

    @cached_property
    def population(self) -> DataFrame:
        return self.records.withColumns({"rotulo": labels.label(F.col("pa_indica_bruto")), "causa": F.when(F.col("quantidade_apresentada") % 5 == 0, metrics.OUT_OF_SCOPE)})

    def one_rule(self, k: int) -> DataFrame:
        if k not in self._one_rule:
            self._one_rule[k] = self.evaluated([RULES[k]], self.aux(RULES[k].rule_id))
        return self._one_rule[k]

    def evaluated(self, chosen: list[rules.Rule], aux: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The evaluations by rules of one family that read one table."""
        cover = self._cover([x for x in RULES if x.family == chosen[0].family])
        return rules.evaluate_rules(chosen, self.stored_records, {r.rule_id: aux for r in chosen}, self.decided, cover, self.versions, keep=keep)

    @cached_property
    def pair_states(self) -> DataFrame:
        """(competencia, cnes, cbo, estado): what the second rule says of each record; few bytes a row."""
        ev = self.evaluated([RULES[1]], self.aux(RULES[1].rule_id), ("competencia_processamento", "cnes", "cbo"))
        return written(ev.select(F.col("competencia_processamento").alias("competencia"), "cnes", "cbo", "estado"), "states")

    @cached_property
    def month_index(self):
        return month_index(F.col("competencia_processamento"))


_FLOWS: dict[tuple, Flow] = {}


def shared_flow(spark: SparkSession, sf_dir: str) -> Flow:
    """The flow of a session over one folder, whose tables don't change while the session lasts: what one
    query has stored (records, coverage, evaluations), the next ones read. Flows of other sessions,
    folders for intermediate tables or numbers of partitions are not shared."""
    bound_broadcasts(spark)
    key = (spark.sparkContext.applicationId, sf_dir, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.shuffle.partitions"))
    if key not in _FLOWS:
        for old in [k for k in _FLOWS if k[0] != key[0]]:
            del _FLOWS[old]
        _FLOWS[key] = Flow(spark, sf_dir)
    return _FLOWS[key]


def shift_sql(expr: str, n: str) -> str:
    i = f"(cast(substr({expr},1,4) as bigint)*12 + cast(substr({expr},5,2) as bigint) - 1 + {n})"
    return f"lpad(cast({i} // 12 as varchar), 4, '0') || lpad(cast({i} % 12 + 1 as varchar), 2, '0')"


_RULE_VALUES = ", ".join(f"('{r.rule_id}','{r.family}','{r.source}','{r.base}',{r.offset})" for r in RULES)
_BASE_MONTH = "case q.base when 'ATENDIMENTO' then r.competencia_atendimento else r.competencia_processamento end"


def _coverage_sql() -> str:
    families = ", ".join(f"('{r.family}','{i}')" for r in RULES for i in r.instruments)
    codes = ", ".join(f"('{a}','{b}')" for a, b in _MAP)
    available = " union ".join(
        f"select f.fam, f.ins, a.{r.month_column} as mes from fam f join {AUX_VIEW[r.rule_id]} a on f.fam = '{r.family}' and {' and '.join(f'a.{c} is not null' for c in r.aux_key)}" + (" join codes c on c.ins = f.ins and c.cod = a.co_registro" if r.mapping else "") for r in RULES
    )
    return f"""select g.*, case when n_prod = 0 then 'AUSENTE' when n_reg = 0 then 'INSUFICIENTE' when base_temporal = 'ATENDIMENTO' and n_nulo > 0 then 'INSUFICIENTE' when n_falta = 0 then 'DISPONIVEL' when n_falta = n_nec then 'AUSENTE' else 'INSUFICIENTE' end as estado,
      case when n_prod = 0 then 'sem_producao' when n_reg = 0 then 'sem_registros' when base_temporal = 'ATENDIMENTO' and n_nulo > 0 then 'atendimento_nulo' when n_falta > 0 then 'faltam=' || l_falta end as motivo from (
      with fam(fam, ins) as (values {families}), codes(ins, cod) as (values {codes}), have as ({available}), bases(b) as (values ('PROCESSAMENTO'),('ATENDIMENTO')),
      vivos as (select * from records where not deletado),
      nec as (select distinct instrumento as ins, competencia_processamento as mes, 'PROCESSAMENTO' as b, competencia_processamento as alvo from vivos union select distinct instrumento, competencia_processamento, 'ATENDIMENTO', competencia_atendimento from vivos where competencia_atendimento is not null),
      cel as (select instrumento as ins, competencia_processamento as mes, count(*) as n, count(*) filter (competencia_atendimento is null) as nulo from vivos where instrumento is not null group by 1, 2),
      falta as (select f.fam, n.ins, n.mes, n.b, count(*) as n_nec, count(*) filter (h.mes is null) as n_falta, array_to_string(list_sort(list(n.alvo) filter (h.mes is null)), ',') as l_falta from nec n join fam f on f.ins = n.ins left join have h on h.fam = f.fam and h.ins = n.ins and h.mes = n.alvo group by all)
      select f.fam as familia_regra, f.ins as instrumento, m.competencia, b.b as base_temporal, (select count(*) from vivos v where v.competencia_processamento = m.competencia) as n_prod, coalesce(c.n, 0) as n_reg, coalesce(c.nulo, 0) as n_nulo, coalesce(x.n_nec, 0) as n_nec, coalesce(x.n_falta, 0) as n_falta, x.l_falta
      from fam f cross join months m cross join bases b left join cel c on c.ins = f.ins and c.mes = m.competencia left join falta x on x.fam = f.fam and x.ins = f.ins and x.mes = m.competencia and x.b = b.b) g"""


def eval_sql(r: rules.Rule, table: str | None = None) -> str:
    """The evaluations of a rule as a union of the cases that a record can be in: not covered by the
    rule, of unknown applicability, without sufficient inputs, or tested. Reasons are rows, and what
    a test's outcome means is a table."""
    aux, k, a = table or AUX_VIEW[r.rule_id], r.record_key, r.aux_key
    count = f"x.{r.positive}" if r.positive else "1"
    same = " and ".join(f"coalesce(x.{q} = t.{c}, false)" for c, q in zip(k, a, strict=True))
    may = " and ".join(f"coalesce(x.{q} = t.{c}, true)" for c, q in zip(k, a, strict=True))
    blank = " or ".join(f"{c} is null" for c in (*r.fields(), *(["co_registro"] if r.mapping else [])))
    asked = "competencia_atendimento" if r.base == "ATENDIMENTO" else "competencia_processamento"
    means = [("1", "''", "CONFORME", "APLICAVEL"), ("2", "'CAMPO_INSUFICIENTE'", "INCONCLUSIVO", "APLICAVEL"), ("4", "''", "VIOLACAO", "APLICAVEL"), ("5", "'COBERTURA_INSUFICIENTE'", "INCONCLUSIVO", "APLICAVEL")]
    if r.no_leading:
        means.append(("3", f"'{r.no_leading}'", "INCONCLUSIVO", "DESCONHECIDA" if r.no_leading == "APLICABILIDADE_DESCONHECIDA" else "APLICAVEL"))
    meaning = ", ".join(f"({n}, {why}, '{state}', '{applies}')" for n, why, state, applies in means)
    lead = f"when count(*) filter (x.{a[0]} = t.{k[0]}) = 0 then 3" if r.no_leading else ""
    reasons = ", ".join(f"('{s}','{w}')" for s, w in rules.REASON_OF_SELECTION.items())
    return f"""select * from (
      with porque(sel, motivo) as (values {reasons}),
      significa(caso, motivo, estado, aplic) as (values {meaning}),
      codigos(ins, co_registro) as (values {", ".join(f"('{x}','{y}')" for x, y in _MAP)}),
      ficha as (select r.*, c.co_registro, s.estado as sel_estado, s.competencia_requerida as mes, s.artifact_ids as sel_artefatos, coalesce(v.estado like 'QUARENTENA%', false) as suspeito
        from records r join selecoes s on s.row_id = r.row_id and s.rule_id = '{r.rule_id}' left join codigos c on c.ins = r.instrumento left join versions v on v.artifact_id = r.artifact_id),
      arquivo as (select m.mes, m.artifact_id, any_value(v.estado) as integ, count(x.artifact_id) as n, count(x.artifact_id) filter (x.{r.month_column} is null or x.{r.month_column} <> m.mes) as alheias
        from (select distinct mes, unnest(sel_artefatos) as artifact_id from ficha where sel_estado = 'SELECIONADA') m left join versions v using (artifact_id) left join {aux} x using (artifact_id) group by all),
      defeito as (select mes, arg_min(motivo, ordem) as motivo from (
          select mes, 1 as ordem, 'ARQUIVO_AUSENTE' as motivo from arquivo where integ is null union all select mes, 2, 'ARQUIVO_EM_QUARENTENA' from arquivo where integ like 'QUARENTENA%'
          union all select mes, 3, 'VIGENCIA_NAO_RESOLVIDA' from arquivo where alheias > 0 union all select mes, 4, 'COBERTURA_INSUFICIENTE' from arquivo group by mes having sum(n) = 0) group by mes),
      firme as (select mes from arquivo group by mes having min(n) > 0 and count(*) = count(*) filter (integ = 'OK')),
      fora as (select row_id from ficha where not suspeito and instrumento not in ({", ".join(f"'{x}'" for x in r.instruments)})),
      duvida as (select row_id, unnest(['APLICABILIDADE_DESCONHECIDA', case when suspeito then 'ARQUIVO_EM_QUARENTENA' else 'CAMPO_INSUFICIENTE' end]) as motivo from ficha where suspeito or instrumento is null),
      lacuna as (select * from (select row_id, 'CAMPO_INSUFICIENTE' as motivo from ficha where {blank} union select row_id, motivo from ficha join porque on sel = sel_estado union select row_id, motivo from ficha join defeito using (mes) where sel_estado = 'SELECIONADA')
        where row_id not in (select row_id from fora union select row_id from duvida)),
      aptas as (select * from ficha where row_id not in (select row_id from fora union select row_id from duvida union select row_id from lacuna)),
      linha as (select q.mes, x.* from (select distinct mes, unnest(sel_artefatos) as artifact_id from aptas) q join {aux} x using (artifact_id)),
      teste as (select t.*, count(*) filter ({same} and {count} > 0) as achados, case when count(*) filter ({same} and {count} > 0) > 0 then 1 when count(*) filter ({may} and coalesce({count} > 0, true)) > 0 then 2 {lead} else 4 end as caso
        from (select distinct mes, {", ".join(k)} from aptas) t left join linha x on x.mes = t.mes group by all),
      julgada as (select p.row_id, achados, case when caso = 4 and (f.mes is null or p.mes is distinct from p.{asked} or c.estado is distinct from 'DISPONIVEL') then 5 else caso end as caso
        from aptas p join teste t on t.mes = p.mes and {" and ".join(f"t.{c} = p.{c}" for c in k)} left join firme f on f.mes = p.mes
        left join cobertura c on c.familia_regra = '{r.family}' and c.instrumento = p.instrumento and c.competencia = p.competencia_processamento and c.base_temporal = '{r.base}'),
      caso as (select row_id, 'NAO_APLICAVEL' as estado, 'NAO_APLICAVEL_DEMONSTRADA' as aplicabilidade, '' as motivos, 0 as n_resultados from fora
        union all select row_id, 'INCONCLUSIVO', 'DESCONHECIDA', string_agg(motivo, ';' order by motivo), 0 from duvida group by row_id
        union all select row_id, 'INCONCLUSIVO', 'APLICAVEL', string_agg(motivo, ';' order by motivo), 0 from lacuna group by row_id
        union all select row_id, estado, aplic, motivo, achados from julgada join significa using (caso))
      select row_id, '{r.rule_id}' as rule_id, estado, aplicabilidade, motivos, n_resultados, sel_estado, artifact_id, procedimento, cnes, cbo, co_registro, competencia_processamento, instrumento, sel_artefatos from caso join ficha using (row_id)) e"""


def ratio_sql(n: str, d: str, scale: int) -> str:
    """Half-even ratio of whole numbers as an exact decimal, null where ``d`` isn't positive."""
    one = 10**scale
    top, low = f"(abs(cast({n} as hugeint)) * {one})", f"cast({d} as hugeint)"
    q, r = f"({top} // {low})", f"({top} % {low})"
    whole = f"({q} + case when 2 * {r} > {low} or 2 * {r} = {low} and {q} % 2 = 1 then 1 else 0 end)"
    return f"case when {d} > 0 then cast(cast(sign({n}) * {whole} as decimal(20,0)) * cast('{1 / one:.{scale}f}' as decimal({scale + 1},{scale})) as decimal(20,{scale})) end"


ORACLE: dict[str, str] = {
    "regras(rule_id, familia, fonte, base, deslocamento)": f"values {_RULE_VALUES}",
    "conhecidas": "select o.*, v.estado as integridade from observations o left join versions v on v.artifact_id = o.artifact_id",
    "partes": f"""select fonte, competencia, parte, count(*) filter (observado_em <= {CUTOFF}) as n_vistos, count(*) as n_total,
        coalesce(list_sort(list(distinct artifact_id) filter (observado_em <= {CUTOFF} and resultado = 'OBTIDO' and integridade in ('OK','NAO_VERIFICADO'))), []) as boas,
        coalesce(list_sort(list(distinct artifact_id) filter (observado_em <= {CUTOFF} and resultado = 'OBTIDO' and artifact_id is not null and coalesce(integridade, '') not in ('OK','NAO_VERIFICADO'))), []) as ruins,
        coalesce(list_sort(list(distinct observation_id) filter (observado_em <= {CUTOFF})), []) as obs from conhecidas group by all""",
    "partes_estado": "select *, case when n_vistos = 0 then 'FORA_DO_CORTE' when len(boas) > 1 then 'AMBIGUA' when len(boas) = 1 then 'SELECIONADA' when len(ruins) > 0 then 'EM_QUARENTENA' else 'AUSENTE' end as estado, case when len(boas) > 0 then boas else ruins end as artifact_ids from partes",
    "declaradas": "select fonte, competencia, list_sort(list(distinct parte)) as esperadas from expected_parts group by all",
    "meses_estado": """select p.fonte, p.competencia, list_sort(list_distinct(flatten(list(p.artifact_ids)))) as artifact_ids, list_sort(list_distinct(flatten(list(p.obs)))) as observation_ids,
        case when bool_and(estado = 'FORA_DO_CORTE') then 'FORA_DO_CORTE' when bool_or(estado = 'AMBIGUA') then 'AMBIGUA' when bool_or(estado = 'EM_QUARENTENA') then 'EM_QUARENTENA' when bool_and(estado in ('AUSENTE','FORA_DO_CORTE')) then 'AUSENTE'
          when (any_value(d.esperadas) is not null or count(parte) filter (estado <> 'FORA_DO_CORTE') > 0) and coalesce(list_sort(list(distinct parte) filter (estado = 'SELECIONADA')), []) is distinct from any_value(d.esperadas) then 'INCOMPLETA' else 'SELECIONADA' end as estado
        from partes_estado p left join declaradas d on d.fonte = p.fonte and d.competencia = p.competencia group by p.fonte, p.competencia""",
    "requeridas": f"select r.row_id, q.rule_id, q.fonte, q.base, {shift_sql(_BASE_MONTH, 'q.deslocamento')} as competencia_requerida from records r cross join regras q",
    "selecoes": "select q.*, case when q.competencia_requerida is null then 'NAO_RESOLVIDA' else coalesce(m.estado, 'AUSENTE') end as estado, coalesce(m.artifact_ids, []) as artifact_ids, coalesce(m.observation_ids, []) as observation_ids from requeridas q left join meses_estado m on m.fonte = q.fonte and m.competencia = q.competencia_requerida",
    "cobertura": _coverage_sql(),
    **{f"av{i}": eval_sql(r) for i, r in enumerate(RULES)},
    "avaliacoes": " union all ".join(f"select * from av{i}" for i in range(len(RULES))),
    "agregados": """select row_id, list_sort(list(rule_id) filter (estado = 'VIOLACAO')) as v, list_sort(list(rule_id) filter (estado = 'CONFORME')) as c, list_sort(list(rule_id) filter (estado = 'INCONCLUSIVO')) as i, list_sort(list(rule_id) filter (estado = 'NAO_APLICAVEL')) as n,
        case when bool_or(estado = 'VIOLACAO') then 'ALERTA' when bool_or(estado = 'INCONCLUSIVO') or not bool_or(estado = 'CONFORME') then 'ABSTENCAO' else 'SEM_VIOLACAO_VERIFICADA' end as resultado from avaliacoes group by row_id""",
    "rotulos": "select *, case trim(pa_indica_bruto, ' ') when '0' then 'NAO_APROVADO' when '5' then 'APROVADO_TOTAL' when '6' then 'APROVADO_PARCIAL' else 'DESCONHECIDO' end as rotulo from records",
    "contradicoes": """select row_id, list_filter([case when rotulo = 'APROVADO_PARCIAL' and quantidade_aprovada = quantidade_apresentada and valor_aprovado = valor_apresentado then 'APROVADO_PARCIAL_SEM_REDUCAO' end,
        case when rotulo in ('APROVADO_TOTAL','APROVADO_PARCIAL') and quantidade_aprovada = 0 then 'APROVADO_SEM_QUANTIDADE_APROVADA' end, case when rotulo = 'APROVADO_TOTAL' and quantidade_aprovada <> quantidade_apresentada then 'APROVADO_TOTAL_COM_QUANTIDADE_DIVERGENTE' end,
        case when rotulo = 'APROVADO_TOTAL' and valor_aprovado <> valor_apresentado then 'APROVADO_TOTAL_COM_VALOR_DIVERGENTE' end, case when rotulo = 'NAO_APROVADO' and quantidade_aprovada > 0 then 'NAO_APROVADO_COM_QUANTIDADE_APROVADA' end,
        case when rotulo = 'NAO_APROVADO' and valor_aprovado > 0 then 'NAO_APROVADO_COM_VALOR_APROVADO' end, case when quantidade_aprovada > quantidade_apresentada then 'QUANTIDADE_APROVADA_MAIOR_QUE_APRESENTADA' end,
        case when valor_aprovado > valor_apresentado then 'VALOR_APROVADO_MAIOR_QUE_APRESENTADO' end], lambda x: x is not null) as cs from rotulos""",
}
PRELUDE = adapter.prelude(**ORACLE)


def oracle(query: str, **more: str) -> str:
    extra = "".join(f",\n{n} AS ({t})" for n, t in more.items())
    return PRELUDE.rstrip("\n") + extra + "\n" + query
