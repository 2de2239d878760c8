"""SQL of the queries of this subpackage that SQL can express; written apart from the operators, as an independent check."""

from __future__ import annotations

#: Characters that are never in consistent form, and words really written in another script.
_ODD = r"[\x{00a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}\x{00ad}\x{ff01}-\x{ff5e}\x{fb00}-\x{fb06}\x{0300}-\x{036f}]"
_OWN = r"(^|[^\p{L}])\p{Greek}*[βγδεζηθλμξπρστφχψωάέήίόύώς]\p{Greek}*|(^|[^\p{L}])\p{Cyrillic}*[бвгджзийклмнптфцчшщъыьэюя]\p{Cyrillic}*"
_FIELDS = (("vadetoros", "breeding"), ("elmuletazo", "location"), ("onetoro", "name"))

_PLACEHOLDER = r"^[^\p{L}\p{N}]*$|\b(por|sin) +(confirmar|designar|determinar|definir|anunciar|conocer|asignar)\b"
_PAGE = r"[|›»€©@#<>]|\d/\d|\b(leer|ver|saber) +(mas|todo|cartel)\b|\bver$|\bcompartir\b|\bcookies\b|\bmenu\b|noticias relacionadas|\babonos? a la venta|\bentradas?\b|\btaquilla|\bsuspendido\b|cartel completo|programacion de la|empresa hara|proximo dia|\babrira\b|\bcontacto\b|\bactualidad\b"


def _plain(x: str) -> str:
    return f"trim(lower(strip_accents({x})))"


def _usable(x: str) -> str:
    return rf"({x} is not null and trim({x}) <> '' and not regexp_matches({x}, '\.\.\.|…') and not regexp_matches({_plain(x)}, '{_PLACEHOLDER}') and not regexp_matches({_plain(x)}, '{_PAGE}'))"


def _all_usable(xs: str) -> str:
    return f"(len({xs}) > 0 and len(list_filter({xs}, lambda z: not coalesce({_usable('z')}, false))) = 0)"


_MEMBERS = (("vadetoros", "fetchedAt", "null"), ("elmuletazo", "fetchedAt", "null"), ("lasventas", "fetchedAt", "null"), ("canalextremadura", "updatedAt", "title"))

SQL = {
    "p1_found": " union all ".join(
        rf"select '{t}' as feed, row_id from {t} where regexp_matches({c}, '{_ODD}') or regexp_matches(regexp_replace(nfc_normalize({c}), '{_OWN}', ' ', 'g'), '\p{{Greek}}|\p{{Cyrillic}}')"
        for t, c in _FIELDS
    ),
    "p5_found": f"""with m as (select distinct group_id, feed, row_id from dupgroups),
  x as ({" union all ".join(f"select '{t}' as feed, row_id, {at} as at_, breeding, participants, channel, {title} as title from {t}" for t, at, title in _MEMBERS)}),
  j as (select group_id, feed, row_id, at_, string_split(breeding, ' / ') as b, participants as p, channel as c, title as t from m join x using (feed, row_id)),
  v as (select group_id, 'breeding' as field, feed, row_id, at_, len(list_distinct(b)) as n from j where {_all_usable("b")}
    union all select group_id, 'participants', feed, row_id, at_, len(list_distinct(p)) from j where {_all_usable("p")}
    union all select group_id, 'channel', feed, row_id, at_, 1 from j where {_usable("c")} and {_plain("c")} not in ('sin tv', 'television', 'tv')
    union all select group_id, 'title', feed, row_id, at_, 1 from j where {_usable("t")})
  select group_id, field, feed, row_id from v qualify row_number() over (partition by group_id, field order by n desc, at_ desc, feed, row_id) = 1""",
    "p9_found": r"""with w as (select item_id as id, true as item, regexp_extract_all(lower(strip_accents("text")), '[\p{L}\p{N}]+') as ws from evalitems where "text" is not null
    union all select doc_id, false, regexp_extract_all(lower(strip_accents("text")), '[\p{L}\p{N}]+') from documents where "text" is not null),
  g as (select id, item, hash(ws[i:i + 11]) as h from (select *, unnest(generate_series(1, len(ws) - 11)) as i from w where len(ws) >= 12))
  select distinct a.id as item_id, b.id as doc_id from g a join g b on a.h = b.h where a.item and not b.item""",
}

SQL["p9_kept_index"] = SQL["p9_found"]
