"""Industry codes: section letter and two digits of the major class, to a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections and major classes of the national industry classification; no name, and what stands for an unknown code.
SECTIONS = "A农、林、牧、渔业 B采矿业 C制造业 D电力、热力、燃气及水生产和供应业 E建筑业 F批发和零售业 G交通运输、仓储和邮政业 H住宿和餐饮业 I信息传输、软件和信息技术服务业 J金融业 K房地产业 L租赁和商务服务业 M科学研究和技术服务业 N水利、环境和公共设施管理业 O居民服务、修理和其他服务业 P教育 Q卫生和社会工作 R文化、体育和娱乐业 S公共管理、社会保障和社会组织 T国际组织"
MAJORS = (
    "A01农业 A02林业 A03畜牧业 A04渔业 A05农、林、牧、渔专业及辅助性活动 B06煤炭开采和洗选业 B07石油和天然气开采业 B08黑色金属矿采选业 B09有色金属矿采选业 B10非金属矿采选业 B11开采专业及辅助性活动 B12其他采矿业 "
    "C13农副食品加工业 C14食品制造业 C15酒、饮料和精制茶制造业 C16烟草制品业 C17纺织业 C18纺织服装、服饰业 C19皮革、毛皮、羽毛及其制品和制鞋业 C20木材加工和木、竹、藤、棕、草制品业 C21家具制造业 C22造纸和纸制品业 C23印刷和记录媒介复制业 "
    "C24文教、工美、体育和娱乐用品制造业 C25石油、煤炭及其他燃料加工业 C26化学原料和化学制品制造业 C27医药制造业 C28化学纤维制造业 C29橡胶和塑料制品业 C30非金属矿物制品业 C31黑色金属冶炼和压延加工业 C32有色金属冶炼和压延加工业 C33金属制品业 "
    "C34通用设备制造业 C35专用设备制造业 C36汽车制造业 C37铁路、船舶、航空航天和其他运输设备制造业 C38电气机械和器材制造业 C39计算机、通信和其他电子设备制造业 C40仪器仪表制造业 C41其他制造业 C42废弃资源综合利用业 C43金属制品、机械和设备修理业 "
    "D44电力、热力生产和供应业 D45燃气生产和供应业 D46水的生产和供应业 E47房屋建筑业 E48土木工程建筑业 E49建筑安装业 E50建筑装饰、装修和其他建筑业 F51批发业 F52零售业 "
    "G53铁路运输业 G54道路运输业 G55水上运输业 G56航空运输业 G57管道运输业 G58多式联运和运输代理业 G59装卸搬运和仓储业 G60邮政业 H61住宿业 H62餐饮业 I63电信、广播电视和卫星传输服务 I64互联网和相关服务 I65软件和信息技术服务业 "
    "J66货币金融服务 J67资本市场服务 J68保险业 J69其他金融业 K70房地产业 L71租赁业 L72商务服务业 M73研究和试验发展 M74专业技术服务业 M75科技推广和应用服务业 N76水利管理业 N77生态保护和环境治理业 N78公共设施管理业 N79土地管理业 "
    "O80居民服务业 O81机动车、电子产品和日用产品修理业 O82其他服务业 P83教育 Q84卫生 Q85社会工作 R86广播、电视、电影和录音制作业 R87文化艺术业 R88体育 R89娱乐业 "
    "S90中国共产党机关 S91国家机构 S92人民政协、民主党派 S93社会保障 S94群众团体、社会团体和其他成员组织 S95基层群众自治组织及其他组织 T96国际组织"
)
UNKNOWN = "未知"
LABELS = {x[0]: x for x in SECTIONS.split(" ")} | {x[:3]: x for x in MAJORS.split(" ")}


def classified(code: Column) -> Column:
    """The label of the code's major class, else of its section, else unknown. The letter's case and white space around don't matter."""
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.coalesce(F.try_element_at(labels, F.substring(c, 1, 3)), F.try_element_at(labels, F.substring(c, 1, 1)), F.lit(UNKNOWN))
