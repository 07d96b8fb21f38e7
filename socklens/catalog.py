"""Field catalog, typed row, tracepoints and TCP states.

Everything here is a fixed domain table: the names, widths and numbers below
have to be exactly these for records and rows to mean the same thing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

# -- fixed values: field name, C type on the wire, marks -------------------
# marks: "ip" = address, "be" = stored in network byte order,
#        "ctx" = read from the calling task, not from the socket.
_FIELDS = """
TCPHeaderLen   u16
NewState       u16
OldState       u16
SRTT           u32
RTT            u32
MDev           u32
MDevMax        u32
RTTVar         u32
RcvRTT         u32
PacketsOut     u32
RetransOut     u32
MaxPacketsOut  u32
MaxPacketsSeq  u32
TotalRetrans   u32
AdvMSS         u16
SAddr          u32  ip
DAddr          u32  ip
DPort          u16  be
LPort          u16  be
BytesReceived  u64
BytesSent      u64
BytesAcked     u64
NumSAcks       u8
UserMSS        u16
RACKRTT        u32
MSSClamp       u16
Task           char ctx
PID            u32  ctx
SegsIn         u32
SegsOut        u32
DsackDups      u32
RateDelivered  u32
RateInterval   u32
SndSSThresh    u32
GSOSegs        u16
DataSegsIn     u32
MaxWindow      u32
SndWnd         u32
WindowClamp    u32
RcvSSThresh    u32
ECNFlags       u8
SndCwnd        u32
PrrOut         u32
Delivered      u32
DeliveredCe    u32
Lost           u32
LostOut        u32
PriorSSThresh  u32
DataSegsOut    u32
RcvSpace       u32
UnAcked        u32
SAcked         u32
RTO            u32
"""

# -- fixed values: columns of the typed row, in column order ---------------
TYPED_COLUMNS = """
Task PID TCPHeaderLen TotalRetrans SAddr DAddr DPort LPort BytesReceived
BytesSent BytesAcked NumSAcks UserMSS MSSClamp AdvMSS RTT SRTT RTTVar RcvRTT
RACKRTT MDev MDevMax SegsIn SegsOut GSOSegs DataSegsIn MaxWindow SndWnd
WindowClamp RcvSSThresh ECNFlags SndCwnd PrrOut Delivered DeliveredCe Lost
LostOut PriorSSThresh DataSegsOut RcvSpace UnAcked SAcked RTO DsackDups
RateDelivered RateInterval SndSSThresh PacketsOut RetransOut MaxPacketsOut
MaxPacketsSeq GeoLocation CCode CSCode Country City Region ASN ASNOrg Hostname
Timestamp
""".split()

# -- fixed values: tracepoints ---------------------------------------------
TRACEPOINTS = (
    "tcp:tcp_retransmit_skb",
    "tcp:tcp_retransmit_synack",
    "tcp:tcp_destroy_sock",
    "tcp:tcp_send_reset",
    "tcp:tcp_receive_reset",
    "tcp:tcp_probe",
    "sock:inet_sock_set_state",
)
STATE_TRACEPOINT = "sock:inet_sock_set_state"

# -- fixed values: TCP states, numbered as in the Linux kernel -------------
TCP_STATES = {
    "TCP_ESTABLISHED": 1,
    "TCP_SYN_SENT": 2,
    "TCP_SYN_RECV": 3,
    "TCP_FIN_WAIT1": 4,
    "TCP_FIN_WAIT2": 5,
    "TCP_TIME_WAIT": 6,
    "TCP_CLOSE": 7,
    "TCP_CLOSE_WAIT": 8,
    "TCP_LAST_ACK": 9,
    "TCP_LISTEN": 10,
    "TCP_CLOSING": 11,
    "TCP_NEW_SYN_RECV": 12,
    "TCP_ALL": 99,
}
ALL_STATES = "TCP_ALL"
IPPROTO_TCP = 6

GEO_COLUMNS = ("GeoLocation", "CCode", "CSCode", "Country", "City", "Region", "ASN", "ASNOrg")

# The kernel socket pointer identifies a socket but is never exported; these
# columns name the same socket in exported rows.
SOCKET_KEY = ("Tracepoint", "Inet", "Hostname", "SAddr", "LPort", "DAddr", "DPort")


@dataclass(frozen=True)
class Field:
    """One catalog entry; ``bits`` is its width in an IPv4 record."""

    name: str
    ctype: str
    is_ip: bool = False
    big_endian: bool = False
    from_task: bool = False

    @property
    def is_text(self) -> bool:
        return self.is_ip or self.ctype == "char"

    @property
    def bits(self) -> int:
        return 128 if self.ctype == "char" else int(self.ctype[1:])

    def width(self, inet: int) -> int:
        """Bytes this field takes in a record of the given address family."""
        return 16 if self.is_ip and inet == 6 else self.bits // 8

    def alignment(self, inet: int) -> int:
        return 1 if self.ctype == "char" else self.width(inet)

    @property
    def spark_type(self) -> T.DataType:
        if self.is_text:
            return T.StringType()
        return T.IntegerType() if self.bits <= 16 else T.LongType()


def _read(line: str) -> Field:
    name, ctype, *marks = line.split()
    return Field(name, ctype, "ip" in marks, "be" in marks, "ctx" in marks)


FIELDS = {f.name: f for f in map(_read, _FIELDS.strip().splitlines())}
_BY_LOWER = {name.lower(): name for name in FIELDS}


def canonical(name: str) -> str:
    """Catalog spelling of a field name given in any case."""
    try:
        return _BY_LOWER[name.lower()]
    except KeyError:
        raise ValueError(f"unknown field: {name}") from None


def field(name: str) -> Field:
    return FIELDS[canonical(name)]


def state_name(name: str) -> str:
    """Upper-cased state name, checked."""
    if name.upper() not in TCP_STATES:
        raise ValueError(f"unknown TCP state: {name}")
    return name.upper()


def check_tracepoint(name: str) -> str:
    if name not in TRACEPOINTS:
        raise ValueError(f"unknown tracepoint: {name}")
    return name


def typed_type(name: str) -> T.DataType:
    """Spark type of a typed-row column."""
    if name == "Timestamp":
        return T.LongType()
    return FIELDS[name].spark_type if name in FIELDS else T.StringType()


def typed_schema() -> T.StructType:
    """The 61 nullable columns of the typed row."""
    return T.StructType([T.StructField(n, typed_type(n)) for n in TYPED_COLUMNS])


def event_schema(fields=None) -> T.StructType:
    """Schema of an exported event: the selected fields, then the stamps."""
    names = [canonical(f) for f in fields] if fields else list(FIELDS)
    columns = [T.StructField(n, FIELDS[n].spark_type) for n in names]
    columns += [T.StructField("Timestamp", T.LongType()), T.StructField("Hostname", T.StringType())]
    return T.StructType(columns)


def catalog(spark: SparkSession) -> dict[str, DataFrame]:
    """The domain tables as small DataFrames: fields, tracepoints, states."""
    return {
        "fields": spark.createDataFrame(
            [
                (f.name, f.ctype, f.bits, f.width(6) * 8, f.is_ip, f.big_endian, f.name in TYPED_COLUMNS)
                for f in FIELDS.values()
            ],
            "Field string, CType string, BitsV4 int, BitsV6 int, IsAddress boolean, "
            "BigEndian boolean, InTypedRow boolean",
        ),
        "tracepoints": spark.createDataFrame([(t,) for t in TRACEPOINTS], "Tracepoint string"),
        "states": spark.createDataFrame(list(TCP_STATES.items()), "StateName string, State int"),
    }
