"""SQL that says what operators without a plain SQL form do: stems and robots rules, step by step."""

from __future__ import annotations


def _shape(word: str) -> str:
    """Vowels as V and consonants as C; y is a vowel after a consonant."""
    out = f"regexp_replace(regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        out = f"regexp_replace(regexp_replace({out}, 'Cy', 'CV', 'g'), 'Vy', 'VC', 'g')"
    return out


def _m(word: str) -> str:
    return f"len(regexp_extract_all({_shape(word)}, 'V+C+'))"


def _vowel(word: str) -> str:
    return f"contains({_shape(word)}, 'V')"


def _short(word: str) -> str:
    return f"(regexp_matches({_shape(word)}, 'CVC$') and not regexp_matches({word}, '[wxy]$'))"


def _less(word: str, n: str) -> str:
    return f"left({word}, length({word}) - {n})"


def _rules(step: str, prior: str, rules: str) -> str:
    """A step that replaces the longest suffix of ``rules`` (``old=new`` by blanks) behind a stem with a vowel-consonant sequence."""
    pairs = [x.split("=") for x in rules.split()]
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in pairs)
    return f"""{step}a as (select token, w, regexp_extract(w, '({'|'.join(a for a, _ in pairs)})$') as suf from {prior}),
{step} as (select token, case when suf <> '' and {_m(_less('w', 'length(suf)'))} > 0 then {_less('w', 'length(suf)')} || case suf {cases} else '' end else w end as w from {step}a)"""


def stems(vocabulary: str) -> str:
    """Common table expressions that end in ``stems (token, stem)`` of the tokens of table ``vocabulary``."""
    steps = [
        f"p0 as (select token, token as w from {vocabulary} where regexp_matches(token, '^[a-z]+$') and length(token) > 2)",
        f"p1 as (select token, case when regexp_matches(w, '(sses|ies)$') then {_less('w', '2')} when regexp_matches(w, '[^s]s$') then {_less('w', '1')} else w end as w from p0)",
        f"""p2 as (select token, w, case when w like '%eed' then null when w like '%ed' and {_vowel(_less('w', '2'))} then {_less('w', '2')}
  when w like '%ing' and {_vowel(_less('w', '3'))} then {_less('w', '3')} end as cut from p1)""",
        f"""p3 as (select token, case when w like '%eed' then case when {_m(_less('w', '3'))} > 0 then {_less('w', '1')} else w end
  when cut is null then w when regexp_matches(cut, '(at|bl|iz)$') then cut || 'e'
  when right(cut, 1) = left(right(cut, 2), 1) and length(cut) > 1 and {_shape('cut')} like '%C' then case when regexp_matches(cut, '[lsz]$') then cut else {_less('cut', '1')} end
  when {_m('cut')} = 1 and {_short('cut')} then cut || 'e' else cut end as w from p2)""",
        f"p4 as (select token, case when w like '%y' and {_vowel(_less('w', '1'))} then {_less('w', '1')} || 'i' else w end as w from p3)",
        _rules(
            "p5",
            "p4",
            "ational=ate tional=tion enci=ence anci=ance izer=ize bli=ble alli=al entli=ent eli=e ousli=ous ization=ize ation=ate ator=ate alism=al "
            "iveness=ive fulness=ful ousness=ous aliti=al iviti=ive biliti=ble logi=log",
        ),
        _rules("p6", "p5", "icate=ic ative= alize=al iciti=ic ical=ic ful= ness="),
        "p7a as (select token, w, regexp_extract(w, '(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize)$') as suf from p6)",
        f"""p7 as (select token, case when suf <> '' and {_m(_less('w', 'length(suf)'))} > 1 and (suf <> 'ion' or regexp_matches({_less('w', '3')}, '[st]$'))
  then {_less('w', 'length(suf)')} else w end as w from p7a)""",
        f"""p8 as (select token, case when w like '%e' and ({_m(_less('w', '1'))} > 1 or ({_m(_less('w', '1'))} = 1 and not {_short(_less('w', '1'))})) then {_less('w', '1')} else w end as w from p7)""",
        f"p9 as (select token, case when w like '%ll' and {_m('w')} > 1 then {_less('w', '1')} else w end as w from p8)",
        f"stems as (select v.token, coalesce(p9.w, v.token) as stem from {vocabulary} v left join p9 using (token))",
    ]
    return ",\n".join(steps)


def robots(agent: str) -> str:
    """Common table expressions that end in ``rules (host_port, disallow, delay_ms, specific)``."""
    blank = r"'^\s+|\s+$', '', 'g'"
    return rf"""l0 as (select host_port, string_split(replace(coalesce(body, ''), chr(13) || chr(10), chr(10)), chr(10)) as a from robots_rules),
l1 as (select host_port, unnest(generate_series(1, len(a))) as i, unnest(a) as line from l0),
l2 as (select *, regexp_replace(line, {blank}) = '' as empty, lower(regexp_replace(split_part(line, ':', 1), {blank})) as key, contains(line, ':') as colon,
  substr(line, length(split_part(line, ':', 1)) + 2) as value from l1),
l3 as (select *, regexp_replace(value, {blank}) as said from l2),
l4 as (select *, not empty and key = 'user-agent' and lower(said) = '{agent}' as own from l3),
l5 as (select *, coalesce(sum(own::int) over (partition by host_port order by i rows between unbounded preceding and current row), 0) as owns from l4),
l6 as (select *, case when empty then 0 when own then 1 when key = 'user-agent' then (said = '*' and owns = 0)::int end as turn from l5),
l7 as (select *, coalesce(last_value(turn ignore nulls) over (partition by host_port order by i rows between unbounded preceding and current row), 0) = 1
  and not empty and key <> 'user-agent' as active from l6),
l8 as (select *, active and ((key = 'disallow' and (not colon or value = '')) or (key = 'crawl-delay' and not regexp_matches(said, '^[0-9]+$'))) as bad from l7),
l9 as (select *, coalesce(max(bad::int) over (partition by host_port order by i rows between unbounded preceding and current row), 0) = 0 as read from l8),
last as (select host_port, coalesce(max(owns) filter (read), 0) as owns, arg_max(said, i) filter (read and active and key = 'crawl-delay') as delay from l9 group by host_port),
found as (select l9.host_port, said, min(i) as i from l9 join last on last.host_port = l9.host_port and last.owns = l9.owns where read and active and key = 'disallow' group by all),
rules as (select last.host_port, coalesce(list(said order by i) filter (said is not null), []) as disallow, cast(coalesce(cast(any_value(delay) as bigint) * 1000, 5000) as int) as delay_ms,
  any_value(owns) > 0 as specific from last left join found on found.host_port = last.host_port group by last.host_port)"""
