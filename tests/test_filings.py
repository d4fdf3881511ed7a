import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorspark.operators import filings as G

LINES = "issuer long, dt_refer date, sheet string, scope string, ordem string, ini date, code string, ds string, value double"


def doc(issuer, rows):
    return [(issuer, "2023-12-31", s, "con", "ÚLTIMO", "2023-01-01", c, d, float(v)) for s, c, d, v in rows]


INDUSTRIAL = [("DRE", "3.01", "Receita de Venda", 100), ("DRE", "3.03", "Resultado Bruto", 40), ("DRE", "3.05", "Resultado Antes do Resultado Financeiro", 25),
              ("DRE", "3.07", "Resultado Antes dos Tributos", 20), ("DRE", "3.11", "Lucro/Prejuízo Consolidado do Período", 15),
              ("DRE", "3.11.01", "Atribuído a Sócios da Empresa Controladora", 14), ("DFC", "6.01", "Caixa Líquido Atividades Operacionais", 30),
              ("DFC", "6.01.01.02", "Depreciação e amortização", 8), ("DFC", "6.02.01", "Aquisição de Imobilizado", -10), ("DFC", "6.02.02", "Venda de Imobilizado", 3),
              ("BPA", "1", "Ativo Total", 500), ("BPA", "1.01.01", "Caixa e Equivalentes", 50), ("BPA", "1.01.02", "Aplicações Financeiras", 20),
              ("BPP", "2.01.04", "Empréstimos e Financiamentos", 60), ("BPP", "2.02.01", "Empréstimos e Financiamentos", 40),
              ("BPP", "2.03", "Patrimônio Líquido Consolidado", 210), ("BPP", "2.03.09", "Participação dos Acionistas Não Controladores", 10)]
BANK = [("DRE", "3.01", "Receitas da Intermediação Financeira", 90), ("DRE", "3.09", "Lucro ou Prejuízo Líquido Consolidado do Período", 24),
        ("DRE", "3.09.01", "Atribuído a Sócios da Empresa Controladora", 23.6), ("DFC", "6.01.01.01", "Depreciação", 5), ("BPP", "2.07", "Patrimônio Líquido", 228)]


def test_documents(frame):
    d = {r.issuer: r for r in G.documents(frame(LINES, doc(1, INDUSTRIAL) + doc(2, BANK)), F.lit("DFP")).collect()}
    a = d[1]
    assert (a.revenue_ytd, a.ebit_ytd, a.pretax_income_ytd, a.net_income_ytd, a.net_income_controlling_ytd) == (100, 25, 20, 15, 14)
    assert (a.operating_cash_flow_ytd, a.capex_ytd, a.dna_ytd) == (30, -10, 8)
    assert (a.total_assets, a.cash, a.short_term_investments, a.gross_debt, a.equity, a.equity_controlling) == (500, 50, 20, 100, 210, 200)
    assert not a.is_bank and a.ytd_months == 12
    b = d[2]
    assert b.is_bank and b.ebit_ytd is None and b.net_income_controlling_ytd == 23.6 and b.equity == 228 and b.gross_debt is None and b.dna_ytd is None


def test_leaves_only(frame):
    df = frame("k int, code string, value double", [(1, "6.02.01", -10.0), (1, "6.02.01.01", -4.0), (1, "6.02.011", -1.0)])
    assert sorted(r.code for r in G.leaves(df, ["k"]).collect()) == ["6.02.01.01", "6.02.011"]


def test_ttm(frame):
    rows = [(1, "DFP", "2023-12-31", "2023-01-01", 12, 110.0, None, "2024-03-01"), (1, "ITR", "2024-06-30", "2024-01-01", 6, 85.0, 62.0, "2024-08-01"),
            (2, "ITR", "2024-06-30", "2024-01-01", 6, 85.0, 62.0, "2024-08-01")]
    df = frame("issuer long, form string, dt_refer date, fy_start date, ytd_months int, revenue_ytd double, revenue_ytd_prev double, available_from date", rows)
    out = {(r.issuer, r.form): r.revenue_ttm for r in G.add_ttm(df, ("revenue",)).collect()}
    assert out == {(1, "DFP"): 110, (1, "ITR"): 133, (2, "ITR"): None}


def test_availability_and_as_of(frame):
    versions = frame("issuer long, dt_refer date, form string, received date, version int",
                     [(1, "2026-03-31", "ITR", "2026-05-11", 1), (1, "2026-03-31", "ITR", "2026-07-02", 2), (1, "2025-12-31", "DFP", "2026-03-05", 1), (1, "2023-12-31", "DFP", "2024-03-20", 1)])
    docs = frame("issuer long, dt_refer date, form string, v string", [(1, "2026-03-31", "ITR", "q1"), (1, "2025-12-31", "DFP", "annual"), (1, "2023-12-31", "DFP", "2023"), (1, "2020-12-31", "DFP", "unlisted")])
    av = G.availability(docs, versions)
    q1 = av.filter("v = 'q1'").first()
    assert (q1.available_from, q1.last_received, q1.n_versions) == (dt.date(2026, 5, 11), dt.date(2026, 7, 2), 2)
    assert av.count() == 3
    probes = frame("issuer long, as_of date", [(1, "2026-05-10"), (1, "2026-05-11"), (1, "2024-04-01"), (1, "2026-03-04")])
    got = {r.as_of.isoformat(): r.v for r in G.as_of(probes, av, ["v"]).collect()}
    assert got == {"2026-05-10": "annual", "2026-05-11": "q1", "2024-04-01": "2023"}


def test_share_scale(frame):
    docs = frame("issuer string, dt_refer date, shares_total double, equity_controlling double",
                 [("A", "2023-12-31", 1000.0, 5e6), ("B", "2023-12-31", 1e6, 5e6), ("C", "2023-12-31", 1000.0, 5e6)])
    fre = frame("issuer string, dt_refer date, shares_total double", [("A", "2023-05-01", 1e6), ("B", "2023-05-01", 1.1e6)])
    out = {r.issuer: (r.shares_total, r.scale_source) for r in G.fix_share_scale(docs, fre).collect()}
    assert out == {"A": (1e6, "fre"), "B": (1e6, None), "C": (1e6, "bvps")}


def test_split_between(frame):
    ev = frame("sid string, date date, multiplier double", [("a", "2020-01-05", 2.0), ("a", "2020-02-01", 3.0)])
    pr = frame("sid string, s date, e date", [("a", "2020-01-01", "2020-03-01"), ("a", "2020-01-05", "2020-03-01"), ("a", "2020-02-02", "2020-03-01"), ("b", "2020-01-01", "2020-03-01")])
    got = sorted((r.sid, r.s.isoformat(), r.split) for r in G.split_between(ev, pr, "sid", "s", "e").collect())
    assert [g[2] for g in got] == pytest.approx([6.0, 3.0, 1.0, 1.0])
