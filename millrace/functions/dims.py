"""Small dimensions that travel inside expressions."""

#: Two-letter code, three-letter code and name of each country that codes can be turned into.
COUNTRIES = """
VN VNM Vietnam
US USA United States
KR KOR South Korea
CN CHN China
JP JPN Japan
FR FRA France
DE DEU Germany
GB GBR United Kingdom
IT ITA Italy
ES ESP Spain
CA CAN Canada
AU AUS Australia
BR BRA Brazil
IN IND India
RU RUS Russia
MX MEX Mexico
ID IDN Indonesia
NL NLD Netherlands
SA SAU Saudi Arabia
CH CHE Switzerland
SE SWE Sweden
NO NOR Norway
DK DNK Denmark
FI FIN Finland
BE BEL Belgium
AT AUT Austria
PT PRT Portugal
GR GRC Greece
IE IRL Ireland
NZ NZL New Zealand
SG SGP Singapore
MY MYS Malaysia
TH THA Thailand
PH PHL Philippines
HK HKG Hong Kong
TW TWN Taiwan
AR ARG Argentina
CL CHL Chile
CO COL Colombia
ZA ZAF South Africa
EG EGY Egypt
NG NGA Nigeria
KE KEN Kenya
TR TUR Türkiye
PL POL Poland
CZ CZE Czech Republic
HU HUN Hungary
RO ROU Romania
UA UKR Ukraine
IL ISR Israel
AE ARE United Arab Emirates
PK PAK Pakistan
BD BGD Bangladesh
MM MMR Myanmar
LA LAO Laos
KH KHM Cambodia
MO MAC Macau
MN MNG Mongolia
NP NPL Nepal
LK LKA Sri Lanka
KZ KAZ Kazakhstan
UZ UZB Uzbekistan
QA QAT Qatar
KW KWT Kuwait
OM OMN Oman
IR IRN Iran
"""
_ROWS = [line.split(" ", 2) for line in COUNTRIES.strip().splitlines()]
ISO2_TO_ISO3 = {two: three for two, three, _ in _ROWS}
ISO3_TO_NAME = {three: name for _, three, name in _ROWS}
