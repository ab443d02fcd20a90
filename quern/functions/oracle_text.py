"""SQL text of the id and time rules, for oracle queries run by another engine."""

WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def match_id_sql(c: str) -> str:
    loose = rf"^{WS}*(?:.*[/\\])?{WS}*([A-Z][A-Z0-9]*){WS}*[_-]{WS}*([0-9]{{1,18}})(?:\.[A-Z0-9.]*)?{WS}*$"
    return f"case when regexp_matches(upper({c}), '{loose}') then regexp_replace(upper({c}), '{loose}', '\\1_\\2') else nullif({strip_sql(c)}, '') end"


def bundle_sql(c: str) -> str:
    plain = rf"regexp_replace({strip_sql(c)}, '[/\\\s]+$', '')"
    last = rf"regexp_replace({plain}, '^.*[/\\]', '')"
    return f"nullif(lower({strip_sql(last)}), '')"


def player_sql(c: str) -> str:
    s = strip_sql(c)
    names = "'BOT','NULL','NONE','NAN','N/A','NA','UNKNOWN','UNDEFINED','ANONYMOUS'"
    return f"case when {s} <> '' and upper({s}) not in ({names}) and not regexp_full_match({s}, '[0_.?-]+') then {s} end"


def epoch_ms_sql(c: str) -> str:
    return f"case when {c} < 100000000000 then {c} * 1000 when {c} < 100000000000000 then {c} when {c} < 100000000000000000 then {c} // 1000 else {c} // 1000000 end"


def normal_quantile_sql(p: str) -> str:
    """Quantile of the standard normal distribution of an expression in (0, 1), by AS 241."""
    from quern.functions import ranks as r

    def ratio(x: str, top: tuple, bottom: tuple) -> str:
        poly = lambda cs: " + ".join(f"{c!r}::double * ({x}) ** {k}" for k, c in enumerate(cs))
        return f"(({poly(top)}) / ({poly(bottom)}))"

    q, t = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    middle = f"{q} * {ratio(f'(0.180625 - {q} * {q})', r._A, r._B)}"
    side = f"case when {t} <= 5 then {ratio(f'({t} - 1.6)', r._C, r._D)} else {ratio(f'({t} - 5)', r._E, r._F)} end"
    return f"case when abs({q}) <= 0.425 then {middle} else sign({q}) * {side} end"
