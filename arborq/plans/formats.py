"""Vocabularies that come with the engine: RSS 2.0, and the common parts of word-processing and spreadsheet packages."""

from __future__ import annotations

import functools

from .schema import Schema, compile_ebnf

# Element and attribute names of RSS 2.0, as published.
_RSS = {
    "rss": "at_version, channel",
    "channel": "{title | link | description | language | copyright | managingEditor | webMaster | pubDate | lastBuildDate | generator | docs | cloud | ttl | image | rating | textInput | skipHours | skipDays | category | item}",
    "item": "{title | link | description | author | category | comments | enclosure | guid | pubDate | source}",
    "image": "{url | title | link | width | height | description}",
    "textInput": "title, description, name, link",
    "cloud": "at_domain, at_port, at_path, at_registerProcedure, at_protocol",
    "enclosure": "at_url, at_length, at_type",
    "source": "at_url, text",
    "category": "at_domain, text",
    "guid": "at_isPermaLink, text",
    "skipHours": "{hour}",
    "skipDays": "{day}",
}
_RSS_TEXT = "title link description language copyright managingEditor webMaster pubDate lastBuildDate generator docs ttl rating url width height name author comments hour day"

# Local names of the parts of the published office formats that are modelled; the rest is tolerated.
_DOCX = {
    "document": "body", "body": "{p | tbl | sectPr}", "p": "[pPr], {r}", "pPr": "[pStyle], [jc], [spacing], [ind], [numPr]", "numPr": "[ilvl], [numId]",
    "r": "[rPr], {t | br | tab | cr}", "rPr": "[rStyle], [rFonts], [b], [i], [u], [color], [sz], [highlight]",
    "tbl": "[tblPr], [tblGrid], {tr}", "tblPr": "[tblStyle], [tblW]", "tblGrid": "{gridCol}", "tr": "[trPr], {tc}", "trPr": "[trHeight]", "tc": "[tcPr], {p | tbl}", "tcPr": "[tcW], [gridSpan]", "sectPr": "[pgSz], [pgMar]",
    "styles": "[docDefaults], {style}", "docDefaults": "[rPrDefault], [pPrDefault]", "rPrDefault": "[rPr]", "pPrDefault": "[pPr]", "style": "at_type, at_styleId, at_default, [name], [basedOn], [next], [uiPriority], [qFormat], [pPr], [rPr]",
    "fonts": "{font}", "font": "at_name, [panose1], [charset], [family], [pitch]", "settings": "[zoom], [proofState], [defaultTabStop], [characterSpacingControl]", "webSettings": "[optimizeForBrowser], [allowPNG]",
    "numbering": "{abstractNum}, {num}", "abstractNum": "at_abstractNumId, [multiLevelType], {lvl}", "lvl": "at_ilvl, [start], [numFmt], [lvlText], [lvlJc]", "num": "at_numId, [abstractNumId]",
    "hdr": "{p | tbl}", "ftr": "{p | tbl}", "footnotes": "{footnote}", "footnote": "at_id, {p}", "endnotes": "{endnote}", "endnote": "at_id, {p}",
    "theme": "at_name, [themeElements]", "themeElements": "[clrScheme], [fontScheme]", "clrScheme": "at_name", "fontScheme": "at_name, [majorFont], [minorFont]", "majorFont": "[latin]", "minorFont": "[latin]", "latin": "at_typeface",
    "t": "at_space, text", "br": "at_type", "spacing": "at_before, at_after, at_line", "ind": "at_left, at_right, at_hanging", "rFonts": "at_ascii, at_hAnsi", "pgSz": "at_w, at_h", "pgMar": "at_top, at_bottom, at_left, at_right", "gridCol": "at_w", "tblW": "at_w, at_type", "tcW": "at_w, at_type", "color": "at_val",
}
_DOCX_VAL = "pStyle jc ilvl numId rStyle b i u sz highlight tblStyle trHeight gridSpan name basedOn next uiPriority qFormat panose1 charset family pitch defaultTabStop characterSpacingControl multiLevelType start numFmt lvlText lvlJc abstractNumId"
_DOCX_EMPTY = "tab cr zoom proofState optimizeForBrowser allowPNG"
_XLSX = {
    "worksheet": "[dimension], [sheetData]", "dimension": "at_ref", "sheetData": "{row}", "row": "at_r, {c}", "c": "at_r, at_s, at_t, [f], [v], [is]", "is": "[t]", "workbook": "[sheets]", "sheets": "{sheet}", "sheet": "at_name, at_sheetId",
    "sst": "at_count, at_uniqueCount, {si}", "si": "[t]", "styleSheet": "[numFmts], [fonts], [fills], [borders], [cellStyleXfs], [cellXfs], [cellStyles]", "numFmts": "{numFmt}", "numFmt": "at_numFmtId, at_formatCode",
    "fonts": "at_count, {font}", "font": "[b], [i], [sz], [color], [name]", "fills": "{fill}", "fill": "[patternFill]", "patternFill": "at_patternType, [fgColor], [bgColor]", "borders": "{border}", "border": "[left], [right], [top], [bottom]",
    "cellStyleXfs": "{xf}", "cellXfs": "{xf}", "xf": "at_numFmtId, at_fontId, at_fillId, at_borderId, [alignment]", "alignment": "at_horizontal, at_vertical", "cellStyles": "{cellStyle}", "cellStyle": "at_name, at_xfId",
    "table": "at_id, at_name, at_displayName, at_ref, [autoFilter], [tableColumns], [tableStyleInfo]", "autoFilter": "at_ref", "tableColumns": "at_count, {tableColumn}", "tableColumn": "at_id, at_name", "tableStyleInfo": "at_name",
    "comments": "[authors], [commentList]", "authors": "{author}", "commentList": "{comment}", "comment": "at_ref, at_authorId, [e:text]", "calcChain": "{c}", "chartsheet": "[sheetViews], [pageMargins]", "sheetViews": "{sheetView}", "sheetView": "at_workbookViewId", "pageMargins": "at_left, at_right, at_top, at_bottom",
    "e:text": "[t], {r}", "r": "[t]",
    "theme": "at_name, [themeElements]", "themeElements": "[clrScheme], [fontScheme]", "clrScheme": "at_name", "fontScheme": "at_name, [majorFont], [minorFont]", "majorFont": "[latin]", "minorFont": "[latin]", "latin": "at_typeface",
    "sz": "at_val", "name": "at_val", "color": "at_rgb, at_theme", "fgColor": "at_rgb, at_theme", "bgColor": "at_rgb, at_indexed",
}
_XLSX_TEXT, _XLSX_EMPTY = "f v t author", "b i left right top bottom wsDr chartSpace"
_CORE = "title subject creator keywords description lastModifiedBy revision created modified category contentStatus"
_EXTENDED = "Template TotalTime Pages Words Characters Application DocSecurity Lines Paragraphs Company CharactersWithSpaces AppVersion"


def _grammar(rules: dict[str, str], text: str = "", val: str = "", empty: str = "") -> str:
    every = dict(rules)
    for names, body in ((text, "text"), (val, "at_val"), (empty, "")):
        for name in names.split():
            every.setdefault(name, body)
    return "\n".join(f"{name} = {body} ;" for name, body in every.items())


def _properties() -> tuple[dict[str, str], str]:
    return {"coreProperties": "".join(f"[{x}], " for x in _CORE.split()), "Properties": "".join(f"[{x}], " for x in _EXTENDED.split())}, f"{_CORE} {_EXTENDED}"


@functools.cache
def format_schema(name: str) -> Schema:
    """The schema of a format by name (``rss-2.0``, ``docx``, ``xlsx``); compiled on first use."""
    from arborq.operators.rss import rss_rules

    if name == "rss-2.0":
        out = compile_ebnf(_grammar(_RSS, _RSS_TEXT))
        out.root, out.ns_extensible, out.pre_validate = "Rss", True, rss_rules
        return out
    extra, texts = _properties()
    if name == "docx":
        out = compile_ebnf(_grammar(_DOCX | extra, texts, _DOCX_VAL, _DOCX_EMPTY))
    elif name == "xlsx":
        out = compile_ebnf(_grammar(_XLSX | extra, f"{_XLSX_TEXT} {texts}", "", _XLSX_EMPTY))
    else:
        raise KeyError(f"unknown format {name}")
    out.open = True
    return out
