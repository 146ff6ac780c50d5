"""A made-up fleet with everything that configurations may hold, projected from the supplier table.

Every value is arithmetic on the key, in expressions that Spark and other engines read alike, so that each engine makes the
same texts. Twenty devices form a group: a firewall pair, two routers, switches of three vendors; neighbours by key share a
link, a BGP session and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.session import table
from logloom.operators import facts

SITES = ("fra1", "fra2", "lon1", "muc1")


def _int(x: str) -> str:
    return f"cast({x} as bigint)"


def _host(k: str) -> str:
    n, g = f"(({k}) % 20)", _int(f"floor(({k}) / 20)")
    pad = lambda v: f"lpad(cast({v} as string), 2, '0')"
    return f"concat('p', cast({g} as string), '-', case when {n} < 2 then concat('fw-01', case when {n} = 0 then 'a' else 'b' end) when {n} < 4 then concat('rt-', {pad(f'{n} - 1')}) else concat('sw-', {pad(f'{n} - 3')}) end)"


def _second(k: str) -> str:
    return f"100 + {_int(f'floor(({k}) / 200)')} % 100"


K, P, N = "s_suppkey", "(s_suppkey + 199)", "(s_suppkey + 1)"
#: What stands for each name in a text. The device before key k has key k - 1; 20,000 more keep it above 0 and the address the same.
VALUES = {
    "host": _host(K), "next": _host(N), "short": f"substring({_host(N)}, instr({_host(N)}, '-') + 1)",
    "a": _second(K), "b": f"{K} % 200", "pa": _second(f"{K} + 19999"), "pb": f"({K} + 19999) % 200",
    "asn": f"65000 + {K} % 50", "nasn": f"65000 + ({K} + 1) % 50", "pasn": f"65000 + ({K} + 49) % 50",
    "n": f"{K} % 20", "g": f"{_int(f'floor({K} / 20)')} % 250", "vl": f"100 + {K} % 90", "v": f"20 + {K} % 13", "k": K, "m": f"{K} % 14 + 1",
}
EOS = """! device: {host} (DCS-7050SX3)
! boot image EOS-4.{v}.2F
hostname {host}
username admin privilege 15 secret 5 $1$abc{k}
vlan 10
   name MGMT
vlan {vl}
   name STORAGE-{n}
vlan 4001
   name X
interface Ethernet1
   description to {next} port 1
   speed 10000
   ip address 10.{a}.{b}.0/31
interface Ethernet2
   description core ISL
   ip address 10.{pa}.{pb}.1/31
interface Ethernet3
   description Telia transit circuit {k} shutdown
   ip address 62.115.{b}.1/30
interface Management1
   ip address 10.77.{g}.{m}/28
interface Loopback0
   ip address 10.255.{a}.{b}/32
interface Loopback1
   ip address 10.254.{a}.{b}/32
interface Vlan10
   ip address 10.1.{b}.1/24
interface Vxlan1
   vxlan source-interface Loopback1
   vxlan vlan 10 vni 10010
   vxlan vni 50001 vrf TENANT-A
vrf definition TENANT-B
router bgp {asn}
   router-id 10.255.{a}.{b}
   neighbor 10.{a}.{b}.1 remote-as {nasn}
   neighbor 10.{pa}.{pb}.0 remote-as {pasn}
   neighbor 62.115.{b}.2 remote-as 1299
   address-family evpn
router ospf 1
   router-id 10.255.{a}.{b}
mlag configuration
   peer-address 10.{a}.{b}.1
ntp server 10.9.0.1
ntp server 10.9.0.2
logging host 10.9.0.3
radius-server host 10.9.0.4 key 7 0011
snmp-server community public{n} ro
ip route 0.0.0.0/0 62.115.{b}.2
"""
FRR = """frr version 8.4.{n}
hostname {host}
interface lo
 ip address 10.255.{a}.{b}/32
interface swp1
 description link {short}
 ip address 10.{a}.{b}.0/31
interface swp2
 ip address 10.{pa}.{pb}.1/31
interface vxlan{vl}
 vni 10{vl}
vrf TENANT-F
 vni 40001
exit-vrf
router bgp {asn}
 neighbor 10.{a}.{b}.1 remote-as {nasn}
 neighbor 10.{pa}.{pb}.0 remote-as {pasn}
 address-family l2vpn evpn
  advertise-all-vni
router ospf
 ospf router-id 10.255.{a}.{b}
 area 0.0.0.1 stub
"""
SET = """set version 21.4R3
set system host-name {host}
set system login user jane.doe full-name "Jane Doe {n}"
set interfaces xe-0/0/1 unit 0 family inet address 10.{a}.{b}.0/31
set interfaces xe-0/0/1 description "to {next}"
set interfaces xe-0/0/1 gigether-options speed 25g
set interfaces xe-0/0/2 unit 0 family inet address 10.{pa}.{pb}.1/31
set interfaces ge-0/0/3 unit 0 family inet address 4.68.{b}.2/30
set interfaces ge-0/0/3 description "Cogent internet {k}"
set interfaces lo0 unit 0 family inet address 10.255.{a}.{b}/32
set vlans STOR{n} vlan-id 22
set vlans users vlan-id 206
set vlans VX vxlan vni 10{vl}
set switch-options vtep-source-interface LO0
set routing-options autonomous-system {asn}
set protocols bgp group x neighbor 10.{a}.{b}.1 peer-as {nasn}
set protocols bgp group x neighbor 10.{pa}.{pb}.0 peer-as {pasn}
set protocols ospf area 0.0.0.0 interface xe-0/0/1
set protocols lldp interface all
set system ntp server 10.9.0.1
deactivate interfaces ge-0/0/3
"""
SRL = """# device {host}
interface ethernet-1/1 {
    description "to {next}"
    port-speed 25G
    ip ospf area 0.0.0.2
    ip ospf hello-interval 5
    ip ospf dead-interval 20
    ip ospf cost {vl}
    ip ospf network point-to-point
    subinterface 0 {
        ipv4 {
            address 10.{a}.{b}.0/31 {
            }
        }
    }
}
interface ethernet-1/2 {
    subinterface 0 {
        ipv4 {
            address 10.{pa}.{pb}.1/31 {
            }
        }
    }
}
interface system0 {
    subinterface 0 {
        ipv4 {
            address 10.255.{a}.{b}/32 {
            }
        }
    }
}
network-instance default {
    protocols {
        bgp {
            autonomous-system {asn}
            afi-safi evpn
            neighbor 10.{a}.{b}.1 {
                peer-as {nasn}
            }
        }
        protocols ospf
    }
}
vxlan vni 10{vl}
"""
BRACED = """version 20.4R1;
## {host} (SRX345)
system {
    host-name {host};
    login {
        user jane.doe {
            full-name "Jane Doe";
            class super-user;
        }
    }
    services { ssh { protocol-version v2; root-login deny; } }
}
chassis cluster { reth-count 2; }
interfaces {
    ge-0/0/0 {
        description "Lumen uplink {k}";
        unit 0 {
            family inet {
                address 80.239.{b}.2/30;
            }
        }
    }
    xe-0/0/1 {
        description "{next}";
        unit 0 {
            family inet {
                address 10.{a}.{b}.0/31;
            }
        }
    }
    xe-0/0/2 {
        unit 0 {
            family inet {
                address 10.{pa}.{pb}.1/31;
            }
        }
    }
    lo0 {
        unit 0 {
            family inet {
                address 10.255.{a}.{b}/32;
            }
        }
    }
    irb {
        unit 20 {
            family inet {
                address 10.245.207.{m}/24;
            }
        }
    }
    st0.{n} {
        description "hub tunnel";
        family inet {
            address 10.253.{b}.1/30;
        }
    }
}
routing-options { autonomous-system {asn}; router-id 10.255.{a}.{b}; }
protocols {
    bgp {
        group up {
            neighbor 80.239.{b}.1 {
                description "Lumen peer";
                peer-as 3356;
            }
            neighbor 10.{a}.{b}.1 {
                peer-as {nasn};
            }
        }
    }
}
security {
    zones {
        security-zone trust { }
        security-zone untrust { }
        security-zone trust { }
    }
    policies { policy allow { } }
}
vlans {
    IPMI { vlan-id 20; }
    PRODNET { vlan-id 63; }
}
routing-instances CUST {
}
snmp { v3 { usm user x; } }
"""
FORM = f"case when {K} % 20 < 2 then 4 else {K} % 4 end"
PLATFORMS, TEXTS = ("eos", "frr", "junos-ex", "srl", "junos-srx"), (EOS, FRR, SET, SRL, BRACED)


def _by_form(values: tuple[str, ...]) -> str:
    return f"case {FORM} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _text(template: str, literal) -> str:
    out = literal(template)
    for name, value in VALUES.items():
        if "{" + name + "}" in template:
            out = f"replace({out}, '{{{name}}}', cast({value} as string))"
    return out


def columns(literal) -> dict[str, str]:
    """Expressions of host, site_id, platform, function and text; `literal` writes a text as the engine's literal."""
    site = f"case {_int(f'floor({K} / 20)')} % {len(SITES)} " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SITES)) + " end"
    function = f"case when {K} % 20 < 2 then 'firewall' when {K} % 20 < 4 then 'router' else '' end"
    return {"host": _host(K), "site_id": site, "platform": _by_form(tuple(f"'{p}'" for p in PLATFORMS)), "function": function, "text": _by_form(tuple(_text(t, literal) for t in TEXTS))}


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, site_id, platform, function, text of the made-up devices."""
    own = columns(lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'")
    return table(spark, sf_dir, "supplier").select(*[F.expr(e).alias(c) for c, e in own.items()])


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest captures of device_profile and the made-up fleet, as latest_configs() gives them."""
    return facts.latest_configs(table(spark, sf_dir, "device_profile")).unionByName(projected(spark, sf_dir))


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


#: The same as configs() for a second engine: table expression dev(host, site_id, platform, "function", txt).
SQL = f"""WITH d0 AS (SELECT profile_id, nullif(lower(split_part(trim(hostname), '.', 1)), '') AS host, site_id, lower(coalesce(platform, '')) AS platform, coalesce("function", '') AS "function", captured_at, regexp_replace(coalesce(config_text, ''), '\\r', '', 'g') AS txt FROM device_profile),
dev AS (SELECT host, site_id, platform, "function", txt FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY captured_at DESC, profile_id DESC) AS k FROM d0 WHERE host IS NOT NULL) WHERE k = 1
 UNION ALL SELECT {", ".join(f'{e} AS "{"txt" if c == "text" else c}"' for c, e in columns(_quoted).items())} FROM supplier)"""
