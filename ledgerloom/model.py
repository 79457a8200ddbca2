"""Tables of the engine and its fixed names."""

from __future__ import annotations

FACTS = (
    "doc_id string, fact_id string, parent_id string, concept string, ns string, item_type string, value string, "
    "num decimal(38,6), is_nil boolean, decimals string, precision string, context_ref string, unit_ref string, ordinal int"
)
CONTEXTS = (
    "doc_id string, context_id string, scheme string, entity string, period_type string, start timestamp_ntz, end timestamp_ntz, "
    "dims map<string,string>, typed_dims map<string,string>, non_dim string, scenario string, dims_key string"
)
UNITS = "doc_id string, unit_id string, numerator array<string>, denominator array<string>, unit_key string"
CONCEPTS = (
    "concept string, ns string, item_type string, base_types array<string>, subst_group string, subst_groups array<string>, "
    "period_type string, balance string, abstract boolean, nillable boolean, attrs map<string,string>"
)
ARCS = (
    "role string, arcrole string, from string, to string, ord double, weight double, priority int, use string, "
    "preferred_label string, link_name string, arc_name string, attrs map<string,string>"
)
LABELS = "concept string, role string, lang string, text string"
FOOTNOTES = "doc_id string, fact_id string, role string, lang string, text string"
HYPERCUBES = "hypercube string, role string, primary_item string, closed boolean, context_element string"
HYPERCUBE_DIMS = "hypercube string, role string, dimension string, kind string, default_member string"
DIM_MEMBERS = "dimension string, role string, arcrole string, parent string, member string, usable boolean"
VIOLATIONS = "doc_id string, rule string, section string, object_id string, message string"

#: Namespaces and arc roles of the published specifications.
XBRLI = "http://www.xbrl.org/2003/instance"
LINK = "http://www.xbrl.org/2003/linkbase"
XLINK = "http://www.w3.org/1999/xlink"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
XBRLDI = "http://xbrl.org/2006/xbrldi"
ISO4217 = "http://www.xbrl.org/2003/iso4217"
ARCROLES = {
    "parent-child": "http://www.xbrl.org/2003/arcrole/parent-child",
    "summation-item": "http://www.xbrl.org/2003/arcrole/summation-item",
    "general-special": "http://www.xbrl.org/2003/arcrole/general-special",
    "essence-alias": "http://www.xbrl.org/2003/arcrole/essence-alias",
    "similar-tuples": "http://www.xbrl.org/2003/arcrole/similar-tuples",
    "requires-element": "http://www.xbrl.org/2003/arcrole/requires-element",
    "concept-label": "http://www.xbrl.org/2003/arcrole/concept-label",
    "fact-footnote": "http://www.xbrl.org/2003/arcrole/fact-footnote",
    "domain-member": "http://xbrl.org/int/dim/arcrole/domain-member",
    "dimension-domain": "http://xbrl.org/int/dim/arcrole/dimension-domain",
    "dimension-default": "http://xbrl.org/int/dim/arcrole/dimension-default",
    "hypercube-dimension": "http://xbrl.org/int/dim/arcrole/hypercube-dimension",
    "all": "http://xbrl.org/int/dim/arcrole/all",
    "notAll": "http://xbrl.org/int/dim/arcrole/notAll",
}
STANDARD_LABEL = "http://www.xbrl.org/2003/role/label"
#: The item types that carry a unit.
NUMERIC_TYPES = [
    "decimalItemType", "monetaryItemType", "sharesItemType", "pureItemType", "floatItemType", "doubleItemType", "integerItemType",
    "nonPositiveIntegerItemType", "negativeIntegerItemType", "longItemType", "intItemType", "shortItemType", "byteItemType",
    "nonNegativeIntegerItemType", "unsignedLongItemType", "unsignedIntItemType", "unsignedShortItemType", "unsignedByteItemType",
    "positiveIntegerItemType", "fractionItemType",
]
NON_NUMERIC_TYPES = [
    "stringItemType", "booleanItemType", "hexBinaryItemType", "base64BinaryItemType", "anyURIItemType", "QNameItemType", "durationItemType",
    "dateTimeItemType", "timeItemType", "dateItemType", "gYearMonthItemType", "gYearItemType", "gMonthDayItemType", "gDayItemType",
    "gMonthItemType", "normalizedStringItemType", "tokenItemType", "languageItemType", "NameItemType", "NCNameItemType",
    "enumerationItemType", "enumerationSetItemType",
]
#: Units used where an item of a numeric type needs one and none is given, by the type's local name.
DEFAULT_UNITS = {
    "decimalItemType": "pure", "floatItemType": "pure", "doubleItemType": "pure", "monetaryItemType": "USD", "sharesItemType": "shares", "pureItemType": "pure", "fractionItemType": "pure", "integerItemType": "pure",
    "nonPositiveIntegerItemType": "pure", "negativeIntegerItemType": "pure", "longItemType": "pure", "intItemType": "pure", "shortItemType": "pure", "byteItemType": "pure", "nonNegativeIntegerItemType": "pure",
    "unsignedLongItemType": "pure", "unsignedIntItemType": "pure", "unsignedShortItemType": "pure", "unsignedByteItemType": "pure", "positiveIntegerItemType": "pure", "durationItemType": "H", "percentItemType": "pure",
    "perShareItemType": "Monetary_per_Share", "areaItemType": "sqm", "volumeItemType": "m3", "massItemType": "kg", "weightItemType": "kg", "energyItemType": "J", "powerItemType": "W", "lengthItemType": "m", "memoryItemType": "B",
    "voltageItemType": "V", "flowItemType": "Volume_per_Duration", "electricCurrentItemType": "A", "frequencyItemType": "Hz", "perUnitItemType": "Monetary_per_Decimal", "noDecimalsMonetaryItemType": "USD",
    "nonNegativeMonetaryItemType": "USD", "nonNegativeNoDecimalsMonetaryItemType": "USD", "insolationItemType": "pure", "temperatureItemType": "C", "pressureItemType": "Pa", "irradianceItemType": "pure", "speedItemType": "kph",
    "planeAngleItemType": "Degree", "forceItemType": "N", "electricChargeItemType": "C", "massFlowItemType": "pure", "monetaryPerLengthItemType": "Monetary_per_Decimal", "monetaryPerAreaItemType": "Monetary_per_Decimal",
    "monetaryPerVolumeItemType": "Monetary_per_Decimal", "monetaryPerDurationItemType": "Monetary_per_Decimal", "monetaryPerEnergyItemType": "Monetary_per_Decimal", "monetaryPerMassItemType": "Monetary_per_Decimal",
}
